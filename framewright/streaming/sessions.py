"""Crop rates of sessions while they run, and frames of a stream in segments of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.reports import rate


def session_rates_stream(
    crops: DataFrame, gap: str = "5 minutes", watermark: str = "1 minute", by: Sequence[str] = ("session_id",), ts: str = "ts",
) -> DataFrame:
    """Totals and rates of stretches of work: crops of one ``by`` less than ``gap`` apart.

    A stretch comes out once the watermark has passed its end, that is the last crop and the
    gap; until then later crops, late ones too, join it or join two stretches to one.  A crop
    behind the watermark is left out.  Time worked counts from the first crop to the last, a
    second at least.  Tasks merge their own stretches before the shuffle.  Rows without a
    time are left out."""
    timed = crops.where(F.col(ts).isNotNull()).withWatermark(ts, watermark)
    worked = timed.groupBy(*by, F.session_window(ts, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("total"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    seconds = F.greatest(F.lit(1.0), F.col("ended").cast("double") - F.col("started").cast("double"))
    timed = worked.withColumn("seconds", seconds)
    return timed.select(*by, "started", "ended", "total", "seconds", rate("total", "seconds").alias("per_second"),
                        (rate("total", "seconds") * 60).alias("per_minute"))


def frames_in_segments_stream(
    frames: DataFrame, segments: DataFrame, longest: str, frame_delay: str = "1 minute", segment_delay: str = "1 minute",
) -> DataFrame:
    """Frames (video_id, ts, ...) in the segments (video_id, start_ts, end_ts, ...) of their video, both as streams.

    Either side may come first.  A segment waits for frames up to ``longest`` after its start, a frame
    for segments that may have begun as long before it; what is later than its delay is left
    out, so no side is kept for good.  Segments longer than ``longest`` give frames up to it.
    Whole-video segments have no bound and belong to the batch join."""
    f = frames.where("ts is not null").withWatermark("ts", frame_delay)
    names = [c for c in segments.columns if c not in ("video_id",)]
    s = segments.where("start_ts is not null").withWatermark("start_ts", segment_delay).select(F.col("video_id").alias("_video"), *names)
    met = F.expr(f"video_id = _video AND ts >= start_ts AND ts <= end_ts AND ts <= start_ts + interval {longest}")
    return f.join(s, met).drop("_video")
