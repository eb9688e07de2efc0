"""Volume headers, slices in three views, statistics and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.constants import (
    DARK_LEVEL, MAX_DARK_SHARE, MAX_VIEW_ASPECT, MIN_SLICE_STDDEV, MIN_VIEW_SIDE,
)
from framewright.functions import text as X
from framewright.functions.voxels import (
    fold_planes, gray_content, joined_strips, merge_planes, normalised_voxels, slice_pixels, strips,
)
from framewright.plans.ordered import MAX_GROUP_ROWS, number_rows

# Views and the axis each one walks along.
VIEWS = (("axial", 2), ("coronal", 1), ("sagittal", 0))


def view_worth_exporting(w, h, min_side: int = MIN_VIEW_SIDE, max_aspect: float = MAX_VIEW_ASPECT) -> Column:
    w, h = (F.col(v) if isinstance(v, str) else v for v in (w, h))
    return (F.least(w, h) >= min_side) & (
        F.greatest(w, h).cast("double") / F.greatest(F.least(w, h), F.lit(1)) <= max_aspect)


def content_worth_exporting(stddev, dark_share) -> Column:
    s, d = (F.col(v) if isinstance(v, str) else v for v in (stddev, dark_share))
    return (s >= MIN_SLICE_STDDEV) & (d <= MAX_DARK_SHARE)


def mode_check(headers: DataFrame, mode: int | None) -> DataFrame:
    """Add ``skip_reason``; null where the volume can be exported.

    ``mode`` is an axis, or None for all views (two or more dimensions needed).  An axis
    beyond the third has no slices.
    """
    ndim = F.col("dim")[0].cast("int")
    if mode is None:
        reason = F.when(ndim < 2, F.concat(F.lit("unsupported dimension "), ndim.cast("string")))
    else:
        reason = F.when((F.lit(mode) < 0) | (F.lit(mode) >= ndim), F.concat(
            F.lit(f"dimension {mode} is invalid for "), ndim.cast("string"), F.lit("D")))
        reason = F.coalesce(reason, F.lit(f"dimension {mode} has no slices") if mode > 2 else F.lit(None).cast("string"))
    return headers.withColumn("skip_reason", reason)


def axis_of(headers: DataFrame, mode: int) -> DataFrame:
    """One row per volume, the view along axis ``mode``, shaped as :func:`views_of` gives them."""
    name = {axis: view for view, axis in VIEWS}[mode]
    d = [F.greatest(F.lit(1), F.col("dim")[i].cast("int")) for i in range(4)]
    across = [d[i] for i in (1, 2, 3) if i != mode + 1]
    return headers.withColumns({"view": F.lit(name), "axis": F.lit(mode), "n_slices": d[mode + 1], "slice_w": across[0], "slice_h": across[1]})


def view_exports(views: DataFrame, judged: DataFrame) -> DataFrame:
    """What a run made of each view: slices exported and slices of low quality, counted over the
    judged slices, and why a view was left out.  ``views`` has ``worth_view``."""
    counts = judged.groupBy(F.col("volume_id").alias("path"), "view").agg(
        F.count_if("worth").alias("n_exported"), F.count_if(~F.col("worth")).alias("n_low_quality"))
    return views.join(counts, ["path", "view"], "left").withColumns({
        "n_exported": F.coalesce("n_exported", F.lit(0)), "n_low_quality": F.coalesce("n_low_quality", F.lit(0)),
        "skip_reason": F.when(~F.col("worth_view"), "slice size not suitable")})


def views_of(headers: DataFrame) -> DataFrame:
    """One row per volume and view with slice count and slice size.

    Three or more dimensions give all three views, two give the axial view of axis 1.
    """
    d = [F.col("dim")[i].cast("int") for i in range(4)]
    one = F.lit(1)

    def view(name, axis, n, w, h):
        return F.struct(F.lit(name).alias("view"), F.lit(axis).alias("axis"), n.alias("n_slices"),
                        F.greatest(one, w).alias("slice_w"), F.greatest(one, h).alias("slice_h"))

    all_views = F.array(view("axial", 2, d[3], d[1], d[2]), view("coronal", 1, d[2], d[1], d[3]),
                        view("sagittal", 0, d[1], d[2], d[3]))
    flat = F.array(view("axial", 1, d[2], d[1], one))
    return headers.where(d[0] >= 2).select("*", F.inline(F.when(d[0] >= 3, all_views).otherwise(flat)))


def slices_along(slices: DataFrame, axis: int) -> DataFrame:
    """Slices of another view from axial ones ``(volume_id, z, width, height, vox)``.

    Axial slices pass through.  A slice of another view is one row, as large as width (or
    height) times depth.
    """
    if axis == 2:
        return slices.select("volume_id", F.lit("axial").alias("view"), F.col("z").alias("index"),
                             "width", "height", "vox")
    return _recut(slices, [v for v in VIEWS if v[1] == axis])


def all_views(slices: DataFrame) -> DataFrame:
    """Axial, coronal and sagittal slices together; the last two share one shuffle."""
    return slices_along(slices, 2).unionByName(_recut(slices, [v for v in VIEWS if v[1] != 2]))


def _recut(slices: DataFrame, views: list[tuple[str, int]]) -> DataFrame:
    """Strips of consecutive slices travel together, packed in the voxels' own width.  Voxels
    that a slice lacks are not a number; one without place or size is left out."""
    kind = T.StructField("volume_id", slices.schema["volume_id"].dataType)
    place = [kind, T.StructField("view", T.StringType()), T.StructField("index", T.IntegerType())]
    packed = [T.StructField("across", T.IntegerType()), T.StructField("zs", T.BinaryType()), T.StructField("kind", T.StringType()),
              T.StructField("vox", T.BinaryType())]
    sizes = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("vox", T.ArrayType(T.DoubleType()))]
    cut = slices.select("volume_id", "z", "width", "height", "vox").mapInArrow(strips(views), T.StructType([*place, *packed]))
    dealt = cut.repartition("volume_id", "view", "index").sortWithinPartitions("volume_id", "view", "index", "across")
    return dealt.mapInArrow(joined_strips, T.StructType([*place, *sizes]))


def normalise_slices(slices: DataFrame) -> DataFrame:
    """Voxels scaled to [0, 1] slice by slice; no shuffle, a slice is one row."""
    return slices.withColumn("vox", normalised_voxels("vox"))


def gray_slices(slices: DataFrame) -> DataFrame:
    """Slices as 8-bit gray images."""
    return slices.withColumn("px", slice_pixels("vox")).withColumn("n_channels", F.lit(1)).drop("vox")


def slice_content(gray: DataFrame) -> DataFrame:
    """Add deviation, dark share and the ``worth`` flag of gray slices."""
    return gray.withColumn("_c", gray_content("px", F.lit(DARK_LEVEL))).select(
        *gray.columns, "_c.stddev", "_c.dark_share",
        content_worth_exporting("_c.stddev", "_c.dark_share").alias("worth"))


def _finite(v) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def voxel_statistics(slices: DataFrame) -> DataFrame:
    """Min, max, mean, population deviation and count of finite voxels per volume.

    Exploding feeds a partial aggregate in the same stage: one row per task and
    volume is shuffled, whatever the volume's size.
    """
    v = F.col("v").cast("double")
    return slices.select("volume_id", F.explode("vox").alias("v")).where(_finite(v)).groupBy("volume_id").agg(
        F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.avg(v).alias("mean_v"),
        F.stddev_pop(v).alias("stddev_v"), F.count(F.lit(1)).alias("n_finite"))


def project(slices: DataFrame, normalise: str = "slice") -> DataFrame:
    """Maximum and average intensity along z for every (y, x) of a volume.

    A task folds the slices it has to planes before the shuffle, whose rows are rows of a plane.
    """
    if normalise not in ("slice", "none"):
        raise ValueError(f"normalise: {normalise}")
    source = normalise_slices(slices) if normalise == "slice" else slices
    place = [T.StructField("volume_id", slices.schema["volume_id"].dataType), T.StructField("y", T.IntegerType())]
    packed = [T.StructField(c, T.BinaryType()) for c in ("peak", "total", "n")]
    cells = [T.StructField("x", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("max_v", "avg_v")]]
    folded = source.select("volume_id", "width", "vox").mapInArrow(fold_planes, T.StructType([*place, *packed]))
    dealt = folded.repartition("volume_id", "y").sortWithinPartitions("volume_id", "y")
    return dealt.mapInArrow(merge_planes, T.StructType([*place, *cells]))


def series_key(series_uid="series_uid", parent="parent") -> Column:
    """Series of a file: its UID, else its folder."""
    return F.coalesce(F.when(F.col(series_uid) != "", F.col(series_uid)), F.concat(F.lit("dir:"), F.col(parent)))


def slice_position(location="slice_location", position="image_position") -> Column:
    """Slice location, else z of the image position, else 0."""
    z = F.when(F.size(position) >= 3, F.col(position)[2])
    return F.coalesce(F.nanvl(F.col(location), F.lit(None).cast("double")), z, F.lit(0.0))


def rank_in_series(
    tags: DataFrame, max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Slice rank within its series by position, then name."""
    keyed = tags.withColumns({"series": series_key(), "position": slice_position(), "name": X.file_name("path")})
    return number_rows(keyed, ["series"], ["position", "name", "path"], "slice_rank", max_group_rows, at_most)
