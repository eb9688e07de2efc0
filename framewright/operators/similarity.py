"""Near-duplicate tests between consecutive images of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.constants import SIMILARITY_PRESETS
from framewright.functions.pixels import pair_scores
from framewright.functions.text import ignoring_case
from framewright.plans.ordered import MAX_GROUP_ROWS, previous_row

_PRESETS = {name: (d, p, s) for name, d, p, s in SIMILARITY_PRESETS}


def hamming(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))


def is_near(metric: str | Column, dhash_distance, psnr, ssim, preset: str = "Medium") -> Column:
    """Near-duplicate flag by metric: distance at most, PSNR at least or infinite, SSIM at least."""
    d, p, s = _PRESETS[preset]
    metric = F.lit(metric) if isinstance(metric, str) else metric
    psnr, ssim, dist = (F.col(v) if isinstance(v, str) else v for v in (psnr, ssim, dhash_distance))
    return (
        F.when(metric == "DHASH", dist <= d)
        .when(metric == "PSNR", (psnr >= p) | (psnr == F.lit(float("inf"))))
        .when(metric == "SSIM", ssim >= s)
    )


def preset_name(dhash_max, psnr_min, ssim_min) -> Column:
    """Name of the preset whose three thresholds these are, else ``Custom``."""
    d, p, s = (F.col(v) if isinstance(v, str) else v for v in (dhash_max, psnr_min, ssim_min))
    out = F.lit("Custom")
    for name, dd, pp, ss in reversed(SIMILARITY_PRESETS):
        same = (d == dd) & (F.abs(p - F.lit(pp)) < 1e-9) & (F.abs(s - F.lit(ss)) < 1e-9)
        out = F.when(same, F.lit(name)).otherwise(out)
    return out


def consecutive_pairs(
    images: DataFrame, folder: str = "folder", name: str = "name", carry: tuple[str, ...] = ("image_id",),
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Each image with the one before it in name order; ``carry`` gives a_x / b_x columns.

    Carry narrow columns (ids, hashes); pixels are joined to the pairs by id.
    """
    narrow = images.select(folder, name, *[c for c in carry if c not in (folder, name)])
    wanted = {f"a_{c}": c for c in dict.fromkeys(("_seen", name, *carry))}
    rows = previous_row(narrow.withColumn("_seen", F.lit(True)), [folder], ignoring_case(name), wanted,
                        max_group_rows, at_most)
    pairs = rows.where(F.col("a__seen"))
    return pairs.select(
        folder, F.col(f"a_{name}"), F.col(name).alias(f"b_{name}"),
        *[x for c in carry if c != name for x in (F.col(f"a_{c}"), F.col(c).alias(f"b_{c}"))],
    )


def hash_distances(
    measured: DataFrame, max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    pairs = consecutive_pairs(
        measured, carry=("image_id", "dhash"), max_group_rows=max_group_rows, at_most=at_most)
    return pairs.withColumn("distance", hamming("a_dhash", "b_dhash")).drop("a_dhash", "b_dhash")


def score_pairs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``psnr`` and ``ssim`` by joining both images on their unique id."""
    cols = ("px", "height", "width", "n_channels")

    def side(p):
        return images.select(F.col("image_id").alias(f"{p}_image_id"), *[F.col(c).alias(f"_{p}_{c}") for c in cols])

    both = pairs.join(side("a"), "a_image_id").join(side("b"), "b_image_id")
    scores = pair_scores(*[f"_{p}_{c}" for p in "ab" for c in cols])
    return both.withColumn("_s", scores).select(*pairs.columns, "_s.psnr", "_s.ssim")


def screened_pairs(measured: DataFrame, images: DataFrame, preset: str = "Loose") -> DataFrame:
    """Cheap test first: only pairs whose hashes are near have their pixels compared."""
    near = hash_distances(measured).where(F.col("distance") <= _PRESETS[preset][0])
    return score_pairs(near, images)
