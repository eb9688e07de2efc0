"""Judge the images of a folder and write the manifest and the split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import curation as U
from framewright.operators import similarity as S
from framewright.session import cut_lineage
from framewright.sinks.documents import write_curation_csv, write_decisions, write_json
from framewright.sources.images import file_digests, read_images


def run(
    spark: SparkSession, folder: str, out: str, dhash_max: int = 5, recursive: bool = False, **rules,
) -> DataFrame:
    """Measure, decide, flag near-duplicates of the image before, and write the results.

    ``out`` gets ``manifest`` (CSV), ``decisions`` (a table split by decision) and
    ``rejects`` (JSON: files that do not decode); source files stay where they are.  Returns kept and dropped totals.
    """
    images, rejects = read_images(spark, folder, recursive)
    measured = cut_lineage(U.measure(images))
    near = S.hash_distances(measured).where(F.col("distance") <= dhash_max).select(
        F.col("b_image_id").alias("image_id"), F.lit(True).alias("near_duplicate"))
    digests = file_digests(spark, folder, recursive)
    decided = U.decide(measured, **rules).join(digests, "path", "left").join(near, "image_id", "left").withColumn(
        "near_duplicate", F.coalesce("near_duplicate", F.lit(False)))
    base = out.rstrip("/")
    write_curation_csv(U.curation_rows(decided), f"{base}/manifest")
    write_decisions(decided, f"{base}/decisions")
    write_json(rejects, f"{base}/rejects")
    return U.decision_totals(decided)
