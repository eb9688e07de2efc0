"""Slice volumes into gray PNG files, view by view."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.constants import VOXEL_TYPES
from framewright.functions import text as X
from framewright.operators import reports as R
from framewright.operators import volumes as O
from framewright.session import cut_lineage
from framewright.sinks.documents import write_json
from framewright.sinks.png import write_png
from framewright.sources.volumes import read_headers, read_slices, without_cut_short


def run(
    spark: SparkSession, root: str, sink: str, mode: int | None = None, project: str = "Volume slicing", user: str = "",
) -> DataFrame:
    """Export slices of every readable volume: the worthwhile ones of all its views, or all along axis ``mode``.

    A slice lands in ``sink/name/view_slices/name_slice_0001.png``, along one axis in
    ``sink/name/name_slice_0001_dim2.png``.  Returns and writes (``sink/exports``) one row per
    volume and view with counts and a skip reason; unreadable volumes are listed with theirs.
    ``sink/report`` gets the report of the run.
    """
    began, out = time.time(), sink.rstrip("/")
    headers = cut_lineage(without_cut_short(read_headers(spark, root)))
    checked = O.mode_check(headers.where(F.col("reject").isNull()), mode)
    usable = checked.where(F.col("skip_reason").isNull()).drop("skip_reason")
    base = X.volume_base_name(X.file_name("volume_id"))
    if mode is None:
        views = O.views_of(usable).withColumn("worth_view", O.view_worth_exporting("slice_w", "slice_h"))
        volumes = usable.where(F.col("dim")[0] >= 3)
        wanted = views.where("worth_view").select("path", "view")

        def in_view(name: str, axis: int) -> DataFrame:
            chosen = volumes.join(wanted.where(F.col("view") == name), "path", "left_semi")
            return O.slices_along(read_slices(chosen), axis)

        slices = reduce(DataFrame.unionByName, [in_view(*v) for v in O.VIEWS])
        judged = cut_lineage(O.slice_content(O.gray_slices(slices)))
        target = F.format_string(f"{out}/%s/%s_slices/%s_slice_%04d.png", base, F.col("view"), base, F.col("index"))
    else:
        # A run along one axis takes every slice.
        views = O.axis_of(usable, mode).withColumn("worth_view", F.lit(True)) if mode in (0, 1, 2) else O.views_of(usable.limit(0)).withColumn("worth_view", F.lit(True))
        axis = mode if mode in (0, 1, 2) else 2
        judged = cut_lineage(O.gray_slices(O.slices_along(read_slices(usable), axis)).withColumn("worth", F.lit(True)))
        target = F.format_string(f"{out}/%s/%s_slice_%04d_dim%d.png", base, base, F.col("index"), F.lit(axis))
    write_png(judged.where("worth"), target).count()

    rows = cut_lineage(O.view_exports(views, judged))
    left_out = headers.where(F.col("reject").isNotNull()).select("path", F.col("reject").alias("skip_reason")).unionByName(
        checked.where(F.col("skip_reason").isNotNull()).select("path", "skip_reason"))
    columns = ("path", "view", "n_slices", "slice_w", "slice_h", "n_exported", "n_low_quality", "skip_reason")
    exports = cut_lineage(rows.select(*columns).unionByName(left_out, allowMissingColumns=True))
    write_json(exports, f"{out}/exports")
    names = F.create_map(*[F.lit(v) for code, name, _ in VOXEL_TYPES for v in (code, name)])
    told = rows.withColumns({"name": X.file_name("path"), "type_name": names[F.col("datatype").cast("int")]})
    now = time.strftime("%Y-%m-%dT%H%M%SZ", time.gmtime())
    report = R.volume_report(told, X.volume_base_name(X.file_name("path")), root, out, round(1000 * (time.time() - began)), now,
                             str(uuid.uuid4()), project, user, by_axis=mode is not None)
    write_json(report, f"{out}/report")
    return exports
