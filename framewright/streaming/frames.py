"""Frame streams: uniform sampling and near-duplicate drop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framewright.constants import DECIMATE_FRAC, DECIMATE_HI, DECIMATE_LO
from framewright.operators.frames import walk_kept
from framewright.schemas import FRAMES
from framewright.streaming.keyed import rocksdb_state, time_mode
from framewright.streaming.state import AVAILABLE_NOW

LAST_KEPT = T.StructType([f for f in FRAMES.fields if f.name != "video_id"])


def sample_uniform_stream(frames: DataFrame, interval: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """First frame of each tumbling window of a video; late frames end at the watermark.

    ``frames`` has the event time ``ts``.  Each task reduces to one row per video
    and window before the shuffle.
    """
    rest = [c for c in frames.columns if c not in ("video_id", "ts")]
    return (
        frames.withWatermark("ts", watermark)
        .groupBy("video_id", F.window("ts", interval))
        .agg(F.min_by(F.struct("ts", *rest), F.struct("ts", "frame_id")).alias("_f"))
        .select("video_id", F.col("window.start").alias("slot_start"), "_f.*")
    )


class LastKeptFrame(StatefulProcessor):
    """Drops frames that resemble the last kept one of their video; that frame is all the state."""

    def __init__(self, hi: int, lo: int, frac: float, ttl_ms: int | None):
        self.limits, self.ttl_ms = (hi, lo, frac), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST_KEPT, self.ttl_ms)

    def _keep(self, frame: pd.Series) -> None:
        self.last.update((int(frame.frame_id), float(frame.pts_s), int(frame.height), int(frame.width), bytes(frame.px)))

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        self._keep(initial.sort_values(["pts_s", "frame_id"]).iloc[-1])

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True).sort_values(["pts_s", "frame_id"], ignore_index=True)
        size, last = None, None
        if self.last.exists():
            _, _, *size, px = self.last.get()
            last = np.frombuffer(px, np.uint8).reshape(size)
        sizes = frames[["height", "width"]].to_numpy()
        cuts = [0, *(np.flatnonzero((sizes[1:] != sizes[:-1]).any(axis=1)) + 1).tolist(), len(frames)]
        kept = np.zeros(len(frames), bool)
        for a, b in zip(cuts[:-1], cuts[1:]):
            images = np.frombuffer(b"".join(frames.px[a:b]), np.uint8).reshape(b - a, *sizes[a])
            # A frame of another size resembles nothing before it.
            flags = walk_kept(images, last if size is None or list(sizes[a]) == list(size) else None, *self.limits)
            kept[a:b] = flags
            if flags.any():
                size, last = sizes[a].tolist(), images[np.flatnonzero(flags)[-1]]
        if kept.any():
            self._keep(frames.iloc[int(np.flatnonzero(kept)[-1])])
            yield frames[kept]

    def close(self) -> None:
        pass


def drop_near_duplicates_stream(
    frames: DataFrame, out: str, checkpoint: str, initial: DataFrame | None = None, ttl_ms: int | None = None,
    hi: int = DECIMATE_HI, lo: int = DECIMATE_LO, frac: float = DECIMATE_FRAC, trigger: dict | None = None,
) -> StreamingQuery:
    """Near-duplicate drop over an unbounded frame stream; kept frames are written as Parquet.

    The last kept frame of each video is keyed state, so a batch touches its own videos
    only.  ``initial`` (frames as kept by a batch run, or the last of them) is where a new
    query starts from; a query that has run goes on from its own state.  A video that brings
    nothing for ``ttl_ms`` is forgotten and its next frame kept; such a query runs on, so give it
    a ``processingTime`` trigger.  Frames of a video must arrive
    in time order; those of one video in one batch are held together, so bound the trigger.
    """
    rows = frames.select(*FRAMES.names)
    start = None if initial is None else initial.select(*FRAMES.names).groupBy("video_id")
    with rocksdb_state(frames.sparkSession):
        kept = rows.groupBy("video_id").transformWithStateInPandas(
            LastKeptFrame(hi, lo, frac, ttl_ms), FRAMES, "Append", time_mode(ttl_ms, trigger), start)
        return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            **trigger or AVAILABLE_NOW).start()
