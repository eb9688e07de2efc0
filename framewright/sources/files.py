"""File listings and ranged reads.

Listings select metadata only, so Spark never opens the files.  Where a few
bytes decide, ``read_heads`` opens just those files and reads just those bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import text as X


def list_files(spark: SparkSession, root: str | list[str], recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime`` of files; content is pruned."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select(plain_path("path").alias("path"), "length", "modificationTime")


def plain_path(column):
    """Local ``file:`` paths without their scheme; other locations unchanged."""
    return F.regexp_replace(column, "^file:(//)?", "")


def plain_uri(column):
    """Plain path of a location that its source spells as a URI, with %-escapes."""
    return plain_path(F.url_decode(F.regexp_replace(column, r"\+", "%2B")))


def with_kind(paths: DataFrame, column: str = "path") -> DataFrame:
    """Add ``kind``: ``file``, ``folder`` or null for each path, looked up in tasks."""
    schema = T.StructType([*paths.schema.fields, T.StructField("kind", T.StringType())])
    at = paths.columns.index(column)
    names = {pafs.FileType.File: "file", pafs.FileType.Directory: "folder"}

    def kind_of(path: str | None) -> str | None:
        if not path:
            return None
        try:
            fs, name = open_location(path)
            return names.get(fs.get_file_info(name.rstrip("/") or "/").type)
        except (OSError, pa.ArrowInvalid):
            return None

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([kind_of(p) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "kind"])

    return paths.mapInArrow(kinds, schema)


def existing_folders(paths: DataFrame, column: str = "path") -> list[str]:
    """Distinct folders among ``paths`` that exist.  Folders are few next to their files,
    and a reader has to be told its roots."""
    named = with_kind(paths.select(F.col(column).alias("path")).where("path <> ''").distinct())
    return sorted(r["path"] for r in named.where("kind = 'folder'").select("path").collect())


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """``key, size, last_modified`` of objects below a bucket or folder."""
    base = re.sub("^file:(//)?", "", root).rstrip("/") + "/"
    files = list_files(spark, root)
    return files.select(
        F.regexp_replace("path", "^" + _quoted(base), "").alias("key"),
        F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def list_images(spark: SparkSession, root: str, recursive: bool = False, sink: str | None = None) -> DataFrame:
    """Image files by suffix in name order, without the sink folder's own files."""
    files = list_files(spark, root, recursive).where(X.has_extension("path"))
    if sink:
        folder = sink.rstrip("/")
        files = files.where(~F.col("path").startswith(folder + "/"))
    named = files.withColumn("name", X.file_name("path"))
    return named.orderBy(*X.ignoring_case("name"), "path")


def open_location(path: str):
    """File system and path of a location, as tasks open it; plain paths are local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def read_heads(files: DataFrame, n_bytes: int) -> DataFrame:
    """Add ``head``: the first bytes of each file, unpacked for a ``.gz`` name."""
    schema = T.StructType([*files.schema.fields, T.StructField("head", T.BinaryType())])
    at = files.columns.index("path")

    def head_of(path: str) -> bytes | None:
        try:
            fs, name = open_location(path)
            with fs.open_input_stream(name, compression=None) as stream:
                if not path.lower().endswith(".gz"):
                    return stream.read(n_bytes)
                unpack, out = zlib.decompressobj(wbits=47), b""
                while len(out) < n_bytes:
                    packed = stream.read(4096)
                    if not packed:
                        break
                    out += unpack.decompress(packed, n_bytes - len(out))
                return out[:n_bytes]
        except (OSError, zlib.error):
            return None

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([head_of(p) for p in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "head"])

    return files.mapInArrow(heads, schema)
