"""Crop and segment manifests: one JSON document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.constants import (
    DECIMATE_FRAC, DECIMATE_HI, DECIMATE_LO, MIN_FRAME_LUMA, SCENE_THRESHOLD, SEGMENT_PREFIX, UNIFORM_FPS,
)
from framewright.functions import text as X
from framewright.schemas import CROP_MANIFEST, SEGMENT_MANIFEST
from framewright.sources.files import plain_uri


def _documents(spark: SparkSession, root: str, glob: str, schema) -> DataFrame:
    return (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).json(root)
        .withColumn("manifest", plain_uri(F.col("_metadata.file_path")))
    )


def read_crop_manifests(spark: SparkSession, root: str, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """Manifest documents in path order, and the rejected ones with a reason.

    The order reads all documents twice and shuffles them whole; ``ordered=False`` leaves it out."""
    docs = _documents(spark, root, "crop_metadata_*.json", CROP_MANIFEST)
    bad = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(F.col("crops").isNull(), "missing key 'crops'")
    judged = docs.withColumn("reason", bad)
    good = judged.where(F.col("reason").isNull()).drop("reason", "_corrupt_record")
    return good.orderBy(*X.ignoring_case("manifest")) if ordered else good, judged.where(F.col("reason").isNotNull()).select("manifest", "reason")


def crop_requests(manifests: DataFrame) -> DataFrame:
    """One row per crop of a manifest, in every spelling of its coordinates.

    A crop without an image path is a row too: it counts as queued and asks for nothing.
    """
    rows = manifests.select(
        "manifest", F.col("sourceDir").alias("source_dir"), F.col("sinkDir").alias("manifest_sink"),
        F.coalesce(F.col("defaultCropSize.w"), F.lit(0)).alias("default_w"),
        F.coalesce(F.col("defaultCropSize.h"), F.lit(0)).alias("default_h"),
        F.posexplode("crops").alias("ordinal", "c"))
    return rows.select(
        "manifest", "ordinal", "source_dir", "manifest_sink", "default_w", "default_h",
        F.col("c.imagePath").alias("image_path"), F.col("c.annotation").alias("annotation"),
        X.sanitized("c.annotation").alias("prefix"), F.col("c.savedAs").alias("saved_as"),
        F.col("c.sinkDir").alias("sink_override"),
        F.coalesce("c.x1", "c.cropX1").alias("x1"), F.coalesce("c.y1", "c.cropY1").alias("y1"),
        F.coalesce("c.w", "c.cropWidth").alias("w"), F.coalesce("c.h", "c.cropHeight").alias("h"),
        F.col("c.cropTopLeft.x").alias("tl_x"), F.col("c.cropTopLeft.y").alias("tl_y"),
        F.col("c.cropBottomRight.x").alias("br_x"), F.col("c.cropBottomRight.y").alias("br_y"),
    )


def with_option_defaults(docs: DataFrame) -> DataFrame:
    """Extraction options with their defaults; a value counts only when its switch is on."""
    o = "extractionOptions."

    def flag(name):
        return F.coalesce(F.col(o + name), F.lit(False))

    def value(switch, name, default):
        return F.when(flag(switch), F.coalesce(F.col(o + name), F.lit(default)))

    return docs.withColumns({
        "drop_duplicates": flag("dropDuplicates"),
        "hi": value("useCustomMpdecimateParams", "mpdecimateHi", DECIMATE_HI),
        "lo": value("useCustomMpdecimateParams", "mpdecimateLo", DECIMATE_LO),
        "frac": value("useCustomMpdecimateParams", "mpdecimateFrac", DECIMATE_FRAC),
        "fps": value("useUniformSampling", "uniformSamplingFps", UNIFORM_FPS),
        "scene_threshold": value("useSceneChanges", "sceneThreshold", SCENE_THRESHOLD),
        "min_luma": value("skipDarkFrames", "minLumaYavg", MIN_FRAME_LUMA),
    })


def segments_of(docs: DataFrame) -> DataFrame:
    """One row per segment of a manifest; a missing bound means the whole video."""
    rows = docs.select("*", F.explode("segments").alias("segment", "s"))
    return rows.select(
        *[c for c in docs.columns if c not in ("segments", "extractionOptions")], "segment",
        F.coalesce("s.start", F.lit(-1)).alias("start_s"), F.coalesce("s.end", F.lit(-1)).alias("end_s"),
        F.coalesce("s.prefix", F.lit(SEGMENT_PREFIX)).alias("prefix"))


def read_segment_manifests(spark: SparkSession, root: str) -> DataFrame:
    docs = _documents(spark, root, "video_frame_extraction_segments_*.json", SEGMENT_MANIFEST)
    sound = docs.where(F.col("_corrupt_record").isNull() & F.col("videoPath").isNotNull()).drop("_corrupt_record")
    return segments_of(with_option_defaults(sound))
