"""Cut the crops that manifests ask for and write them as PNG files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.operators import catalog as K
from framewright.operators import crops as C
from framewright.session import cut_lineage
from framewright.sinks.png import write_png
from framewright.sources.files import existing_folders, list_files, with_kind
from framewright.sources.images import read_wanted
from framewright.sources.manifests import crop_requests, read_crop_manifests
from framewright.streaming.ledger import finished

ORDER = ("manifest", "ordinal")
_NO_IMAGES = "image_id string, path string, px binary, height int, width int, n_channels int"


def run(
    spark: SparkSession, meta_root: str, image_root: str, sink_root: str, ledger: str,
    force: bool = False, dry_run: bool = False, respect_saved: bool = False, by_size: bool = False,
) -> DataFrame:
    """Process the manifests below ``meta_root`` that the ledger does not hold.

    A relative image path lies under the manifest's source folder where that exists, else
    under ``image_root``; absolute paths are taken as they are.  A crop goes to a sink of
    its own, to its manifest's, or to ``sink_root``, wherever these lie; ``by_size`` adds
    folders ``annotation/WxH`` below it.  ``respect_saved`` keeps the names that crops were
    saved under.  Returns the eight counters as one row.
    """
    good, bad = read_crop_manifests(spark, meta_root)
    done = finished(spark, ledger).select(F.col("path").alias("manifest"))
    todo = K.pending(good, done, "manifest", force)
    asked = crop_requests(todo)
    given = with_kind(asked.select("source_dir").where(X.blank_to_null("source_dir").isNotNull()).distinct(), "source_dir")
    found = given.where("kind = 'folder'").select("source_dir", F.col("source_dir").alias("_source"))
    sink = X.sink_location("sink_override", "manifest_sink", F.lit(sink_root))
    asked = asked.join(found, "source_dir", "left").withColumns({
        "image_id": X.image_location("image_path", F.coalesce("_source", F.lit(image_root))), "sink": sink}).drop("_source")
    asked = C.normalise_requests(asked)
    if by_size:
        asked = asked.withColumn("sink", F.concat_ws("/", "sink", X.storage_key("prefix", "w", "h", F.lit(None).cast("string"))))
    asked = cut_lineage(asked)
    images = read_wanted(spark, asked.select(F.col("image_id").alias("path")).where("path is not null"))
    images = spark.createDataFrame([], _NO_IMAGES) if images is None else images.withColumn("image_id", F.col("path"))
    outcomes = cut_lineage(C.crop_outcomes(asked, images, salt_by=ORDER))

    broken = outcomes.where(F.col("outcome") == "incomplete").select("manifest").distinct()
    ready = outcomes.where(F.col("outcome") == "done").join(broken, "manifest", "left_anti")
    if not dry_run:
        sinks = existing_folders(ready.select(F.col("sink").alias("path")))
        listing = list_files(spark, sinks, recursive=False).select(
            X.parent_of("path").alias("sink"), X.file_name("path").alias("name")) if sinks else \
            spark.createDataFrame([], "sink string, name string")
        named = C.assign_output_names(ready, listing, ORDER, respect_saved)
        # Names depend on what the sink holds, so they are fixed before files are written.
        named = cut_lineage(named.select("image_id", *ORDER, "x", "y", "w", "h", F.concat_ws("/", "sink", "file_name").alias("target")))
        pixels = images.select("image_id", "px", "height", "width", "n_channels")
        tiles = C.render(named, pixels, "image_id", [*ORDER, "target"])
        write_png(tiles.withColumnsRenamed({"w": "width", "h": "height"}), F.col("target")).count()
        finished_now = todo.join(broken, "manifest", "left_anti").select(
            F.col("manifest").alias("path"), F.current_timestamp().alias("finished_at"))

    states = good.select("manifest", F.lit(True).alias("has_crops")).unionByName(
        bad.select("manifest", F.lit(False).alias("has_crops")))
    marked = states.join(done.distinct().withColumn("done", F.lit(True)), "manifest", "left").withColumn(
        "done", F.coalesce("done", F.lit(False)))
    counters = cut_lineage(C.batch_counters(marked, outcomes, "manifest", force))
    if not dry_run:
        finished_now.write.mode("append").parquet(ledger)
    return counters
