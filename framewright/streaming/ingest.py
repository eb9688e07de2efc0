"""Continuous ingest: new files, exact and consecutive duplicates, quality counters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framewright.functions import text as X
from framewright.schemas import INT, LONG, TEXT, struct
from framewright.sources.files import plain_path
from framewright.streaming.keyed import rocksdb_state, time_mode
from framewright.streaming.state import AVAILABLE_NOW

# Parts a popular digest is spread over before its copies meet.
DIGEST_SALTS = 32

LAST_IMAGE = struct(name=TEXT, image_id=LONG, dhash=LONG)
HASH_PAIR = struct(folder=TEXT, a_name=TEXT, b_name=TEXT, a_image_id=LONG, b_image_id=LONG, distance=INT)


def new_objects(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Stream of image files as they appear; bounded triggers keep each batch small.

    What was taken is remembered by the query's checkpoint, so a restart goes on
    where it stopped and skips what is there.
    """
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files).option("latestFirst", "false").option("recursiveFileLookup", "true").load(root)
    )
    return raw.withColumn("path", plain_path("path")).where(X.has_extension("path"))


def drop_exact_copies(files: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First file per content digest within the watermark, in two steps.

    Copies of one popular file first meet under a salt, so at most one row per
    salt and digest reaches the single key.
    """
    digested = files.withColumn("sha256", F.sha2("content", 256)) if "sha256" not in files.columns else files
    digested = digested.drop("content")  # digests travel, files do not
    salted = digested.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(DIGEST_SALTS)))
    return (
        salted.withWatermark("modificationTime", watermark)
        .dropDuplicatesWithinWatermark(["sha256", "_salt"])
        .dropDuplicatesWithinWatermark(["sha256"]).drop("_salt")
    )


class LastImage(StatefulProcessor):
    """Pairs each image with the one before it in its folder; that image is all the state."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms, self.pair = ttl_ms, Row(*HASH_PAIR.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST_IMAGE, self.ttl_ms)

    def handleInitialState(self, key, initial, timer_values) -> None:
        self.last.update((initial["name"], initial["image_id"], initial["dhash"]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        images = sorted(((r["name"], r["image_id"], r["dhash"]) for r in rows), key=lambda i: (i[0].lower(), i[0], i[1]))
        for image in images:
            if before is not None:
                known = before[2] is not None and image[2] is not None
                apart = ((before[2] ^ image[2]) & 0xFFFFFFFFFFFFFFFF).bit_count() if known else None
                yield self.pair(key[0], before[0], image[0], before[1], image[1], apart)
            before = image
        self.last.update(tuple(before))

    def close(self) -> None:
        pass


def consecutive_distances_stream(
    measured: DataFrame, out: str, checkpoint: str, initial: DataFrame | None = None, ttl_ms: int | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Hash distance of each image to the one before it in its folder, batch after batch, as Parquet.

    ``measured`` has folder, name, image_id and dhash.  The last image of each folder is
    keyed state, so a batch touches its own folders only; ``initial`` (one row per folder, the
    last image of a batch run) is where a new query starts from, and a folder that brings
    nothing for ``ttl_ms`` is forgotten (with a ``processingTime`` trigger).  Images of one folder in one batch are sorted together.
    """
    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("folder").cast("string").alias("folder"), "name", F.col("image_id").cast("long").alias("image_id"), "dhash")

    start = None if initial is None else named(initial).groupBy("folder")
    with rocksdb_state(measured.sparkSession):
        pairs = named(measured).groupBy("folder").transformWithState(
            LastImage(ttl_ms), HASH_PAIR, "Append", time_mode(ttl_ms, trigger), start)
        return pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            **trigger or AVAILABLE_NOW).start()


def observed_decisions(decided: DataFrame, name: str = "curation") -> DataFrame:
    """Attach running kept and dropped counts to a stream or batch as a metric."""
    return decided.observe(
        name, F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "drop").alias("dropped"))


class ProgressListener(StreamingQueryListener):
    """Sums an observed metric over the batches of the queries of a session."""

    def __init__(self, name: str = "curation"):
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for key, value in row.asDict().items():
                self.totals[key] = self.totals.get(key, 0) + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
