"""A local mirror of a store: head first, then the tail, with an outcome per object."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.constants import IMAGE_SIGNATURES
from framewright.sources.files import open_location
from framewright.sources.head_first import head_first_objects
from framewright.streaming.state import AVAILABLE_NOW, write_batch

OUTCOMES = "key string, admission long, phase string, outcome string"


def mirror_objects(objects: DataFrame, root: str, mirror: str) -> DataFrame:
    """Copy what ``mirror`` lacks; ``outcome`` is ``downloaded``, ``skipped`` or ``failed``.

    An object is there if it is not empty.  What is empty, cannot be read or does not begin
    like an image is failed.  A copy gets its name when it is whole.  Run an action once on
    the result: it copies.
    """
    def outcome(key: str) -> str:
        try:
            held, target = open_location(f"{mirror.rstrip('/')}/{key}")
            info = held.get_file_info(target)
            if info.is_file and info.size > 0:
                return "skipped"
            store, source = open_location(f"{root.rstrip('/')}/{key}")
            with store.open_input_stream(source) as stream:
                data = stream.read()
            if not data.startswith(IMAGE_SIGNATURES):
                return "failed"
            folder, _, leaf = target.rpartition("/")
            held.create_dir(folder, recursive=True)
            part = f"{folder}/._{uuid.uuid4().hex}_{leaf}.part"
            with held.open_output_stream(part) as out:
                out.write(data)
            held.move(part, target)
            return "downloaded"
        except OSError:
            return "failed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcomes = pa.array([outcome(k) for k in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, outcomes], [*batch.schema.names, "outcome"])

    return objects.select("key", "admission", "phase").mapInArrow(run, OUTCOMES)


def mirror_stream(
    spark: SparkSession, root: str, mirror: str, out: str, checkpoint: str, head: int = 20, tail: int = 1000, scope: str = "",
    settle_ms: int = 1000, tasks: int | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Mirror a store as it grows; the outcomes of each trigger are one part of ``out``.

    A trigger's objects are dealt over ``tasks`` tasks by key.  A trigger that is run again
    finds its copies there and calls them skipped.  With the default trigger each call takes
    one admission and ends; give ``{"processingTime": ...}`` to go on."""
    objects = head_first_objects(spark, root, head, tail, scope, settle_ms)
    n = tasks or spark.sparkContext.defaultParallelism

    def step(batch: DataFrame, batch_id: int) -> None:
        write_batch(mirror_objects(batch.repartition(n, "key"), root, mirror), out, batch_id)

    return objects.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger or AVAILABLE_NOW).start()


def mirror_totals(outcomes: DataFrame) -> DataFrame:
    """Totals per phase of what :func:`mirror_stream` wrote."""
    return outcomes.groupBy("phase").agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col("outcome") == o).alias(o) for o in ("downloaded", "skipped", "failed")])
