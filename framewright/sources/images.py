"""Decoded images from Spark's ``image`` source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.sources.files import existing_folders, plain_path, plain_uri


def read_wanted(spark: SparkSession, paths: DataFrame) -> DataFrame | None:
    """Readable images among the distinct ``path`` values, wherever they lie; null where none
    of their folders exists.  Only the folders of wanted images are read."""
    folders = existing_folders(paths.select(X.parent_of("path").alias("path")))
    if not folders:
        return None
    return read_images(spark, folders, recursive=False)[0].join(paths.select("path").distinct(), "path", "left_semi")


# Files that one task decodes where their number is known.
TASK_FILES = 10_000


def read_images(
    spark: SparkSession, root: str | list[str], recursive: bool = True, n_files: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Readable images and the reject table of image files that do not decode.

    Pixels stay in the order the source delivers: blue, green, red[, alpha].  A scan counts
    every file as 4 MB at least, so small ones come 32 to a task; ``n_files`` about how many
    there are puts up to ``TASK_FILES`` in a task.
    """
    raw = (
        spark.read.format("image").option("dropInvalid", "false")
        .option("recursiveFileLookup", str(recursive).lower()).load(root).select("image.*")
        .withColumn("path", plain_uri("origin")).where(X.has_extension("path"))
    )
    if n_files is not None:
        raw = raw.coalesce(max(spark.sparkContext.defaultParallelism, -(-n_files // TASK_FILES)))
    good = raw.where(F.col("height") > 0).select(
        F.xxhash64("path").alias("image_id"), "path", X.file_name("path").alias("name"),
        X.parent_of("path").alias("folder"), "width", "height", F.col("nChannels").alias("n_channels"),
        F.col("data").alias("px"))
    bad = raw.where(F.col("height") <= 0).select("path", F.lit("unreadable image").alias("reason"))
    return good, bad


def file_digests(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, bytes, sha256`` of image files, hashed in the JVM."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select(plain_path("path").alias("path"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256")).where(X.has_extension("path"))
