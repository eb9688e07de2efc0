"""Exports that start once a session has queued enough primary crops."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framewright.plans.ordered import MAX_GROUP_ROWS, running_sum
from framewright.streaming.keyed import rocksdb_state
from framewright.streaming.state import AVAILABLE_NOW

COUNTS = T.StructType([T.StructField("queued", T.LongType()), T.StructField("exported", T.LongType())])


def export_sequences(
    crops: DataFrame, threshold: int, session: str = "session_id", order: tuple[str, ...] = ("seq",),
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Number of the export each crop goes into; null while its queue is not full.

    An export takes everything queued up to and including the primary crop that
    fills it, so the crops after it wait for the next one.
    """
    weighed = crops.withColumn("_p", F.col("is_primary").cast("long"))
    counted = running_sum(weighed, [session], list(order), "_p", "_seen", max_group_rows, at_most)
    # The filling primary crop belongs to the export it completes.
    before = F.col("_seen") - F.col("_p")
    export = F.floor(before / F.lit(threshold)) + 1
    whole = crops.where("is_primary").groupBy(session).agg(
        F.floor(F.count(F.lit(1)) / F.lit(threshold)).alias("_whole"))
    numbered = counted.withColumn("_export", export).join(whole, session, "left")
    full = F.col("_export") <= F.coalesce("_whole", F.lit(0))
    return numbered.withColumn("export_sequence", F.when(full, F.col("_export").cast("long"))).drop(
        "_p", "_seen", "_export", "_whole")


class ExportQueue(StatefulProcessor):
    """Queue of one session: the crops that wait, how many of them are primary, and the exports made.

    A batch reads the waiting crops only if it fills an export, and otherwise adds its own
    behind them, so its work follows its rows."""

    def __init__(self, rows: T.StructType, order: tuple[str, ...], threshold: int):
        self.types, self.threshold, self.numbered = rows, threshold, Row(*rows.names, "export_sequence")
        self.primary, self.order = rows.names.index("is_primary"), [rows.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.types)
        self.counts = handle.getValueState("counts", COUNTS)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        queued, exported = self.counts.get() if self.counts.exists() else (0, 0)
        held: list[tuple] = []
        for row in sorted((tuple(r) for r in rows), key=lambda r: [(r[i] is not None, r[i]) for i in self.order]):
            held.append(row)
            queued += bool(row[self.primary])
            if queued == self.threshold:
                exported += 1
                if self.waiting.exists():
                    yield from (self.numbered(*r, exported) for r in self.waiting.get())
                    self.waiting.clear()
                yield from (self.numbered(*r, exported) for r in held)
                held, queued = [], 0
        if held:
            self.waiting.appendList(held)
        self.counts.update((queued, exported))

    def close(self) -> None:
        pass


def auto_export(
    crops: DataFrame, threshold: int, out: str, checkpoint: str, session: str = "session_id",
    order: tuple[str, ...] = ("seq",), trigger: dict | None = None,
) -> StreamingQuery:
    """Write full exports of a crop stream as Parquet; the rest stays queued in the session's state.

    Crops of a batch are taken in ``order``, batches as they come.  A row whose ``is_primary`` is
    null is not primary.  What a full export holds is emitted row by row, so a long queue is
    never gathered; the crops of one session in one batch are."""
    kept = crops.schema
    with rocksdb_state(crops.sparkSession):
        numbered = crops.groupBy(session).transformWithState(
            ExportQueue(kept, order, threshold), T.StructType([*kept.fields, T.StructField("export_sequence", T.LongType())]), "Append", "None")
        return numbered.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            **trigger or AVAILABLE_NOW).start()
