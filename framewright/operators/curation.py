"""Image measures, keep/drop rules with reasons, and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.constants import BLUR_THRESHOLD, FOCUS_PRESETS, MIN_LUMA
from framewright.functions.pixels import custom_measure, image_measures


def measure(images: DataFrame) -> DataFrame:
    """Replace pixels by ``var_laplacian``, ``mean_luma`` and ``dhash``.

    One Arrow pass over the scan's own partitions; pixels never reach a shuffle.
    An undecodable image gets null measures.
    """
    m = image_measures("px", "height", "width", "n_channels")
    return images.withColumn("_m", m).drop("px").select(
        *[c for c in images.columns if c != "px"], "_m.var_laplacian", "_m.mean_luma", "_m.dhash")


def with_measure(images: DataFrame, name: str, fn) -> DataFrame:
    """Add a user's own measure; see ``custom_measure`` for what ``fn`` takes and returns."""
    return images.withColumn(name, custom_measure(fn)("px", "height", "width", "n_channels"))


def blurry(threshold: float = BLUR_THRESHOLD) -> Column:
    return F.col("var_laplacian") < F.lit(float(threshold))


def dark(threshold: float = MIN_LUMA) -> Column:
    return F.col("mean_luma") < F.lit(float(threshold))


def decide(
    measured: DataFrame, use_blur: bool = True, blur_threshold: float = BLUR_THRESHOLD,
    use_luma: bool = True, min_luma: float = MIN_LUMA,
) -> DataFrame:
    """Add ``decision`` and ``reason``; unreadable images are left out, as a skip."""
    reasons = []
    if use_blur:
        reasons.append(F.when(blurry(blur_threshold), F.lit("blurry")))
    if use_luma:
        reasons.append(F.when(dark(min_luma), F.lit("dark")))
    reason = F.concat_ws(" ", *reasons) if reasons else F.lit("")
    return (
        measured.where(F.col("var_laplacian").isNotNull())
        .withColumn("reason", reason)
        .withColumn("decision", F.when(F.col("reason") == "", "keep").otherwise("drop"))
    )


def unreadable(measured: DataFrame) -> DataFrame:
    """The reject table of a measured collection."""
    return measured.where(F.col("var_laplacian").isNull())


def decision_totals(decided: DataFrame, *by: str) -> DataFrame:
    return decided.groupBy(*by).agg(
        F.count_if(F.col("decision") == "keep").alias("kept"),
        F.count_if(F.col("decision") == "drop").alias("dropped"),
    )


def focus_flags(measured: DataFrame) -> DataFrame:
    """One row per image and preset: is it at least as sharp as the preset asks?"""
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(t).alias("threshold")) for n, t in FOCUS_PRESETS])
    return measured.select("*", F.inline(presets)).withColumn(
        "sharp_enough", F.col("var_laplacian") >= F.col("threshold"))


def curation_rows(decided: DataFrame) -> DataFrame:
    """The 15-column curation manifest of decided images."""
    return decided.select(
        F.col("name").alias("filename"), "width", "height", F.col("bytes").cast("long").alias("bytes"),
        "sha256", "dhash", "var_laplacian", "mean_luma", F.lit("curation").alias("metric"),
        F.format_string("varLap=%.1f,meanY=%.1f", "var_laplacian", "mean_luma").alias("metric_value"),
        F.col("near_duplicate"), F.lit(None).cast("string").alias("source_video"),
        F.lit(None).cast("double").alias("timecode_sec"), "decision", "reason",
    )
