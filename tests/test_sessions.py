"""Rates of running sessions, and the join of two streams."""

from datetime import datetime, timedelta

from framewright.streaming import sessions

START = datetime(2024, 1, 1)


def fed(spark, path, schema, *parts):
    """A stream that has got one file per part, taken one a batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def worked_off(spark, df, tmp_path):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_sessions_close_after_their_gap(spark, tmp_path):
    schema = "session_id long, ts timestamp, size string"
    stream = fed(
        spark, str(tmp_path / "in"), schema,
        [(1, at(0), "a"), (1, at(1), "b"), (2, at(0), "a"), (1, None, "a")],
        [(1, at(8), "a"), (1, at(4), "late, but it joins two stretches"), (2, at(30), "a")],
        [(2, at(31), "a")],
        [(3, at(90), "a")],
        [(1, at(2), "behind the watermark"), (3, at(91), "a")])
    got = worked_off(spark, sessions.session_rates_stream(stream, "5 minutes", "10 minutes"), tmp_path)
    rows = sorted((r.session_id, r.started, r.ended, r.total, r.seconds, round(r.per_minute, 6)) for r in got.collect())
    assert rows == [
        (1, at(0), at(8), 4, 480.0, 0.5), (2, at(0), at(0), 1, 1.0, 60.0), (2, at(30), at(31), 2, 60.0, 2.0)]


def test_frames_meet_segments_whichever_comes_first(spark, tmp_path):
    frames = fed(spark, str(tmp_path / "f"), "video_id long, frame_id long, ts timestamp",
                 [(1, 1, at(0)), (1, 2, at(5)), (2, 1, at(5)), (1, 9, None)], [(1, 3, at(11)), (1, 4, at(40))])
    segments = fed(spark, str(tmp_path / "s"), "video_id long, seg int, start_ts timestamp, end_ts timestamp",
                   [(1, 1, at(4), at(11)), (1, 7, None, at(9))], [(1, 2, at(0), at(90)), (2, 1, at(6), at(9)), (1, 3, at(20), at(10))])
    df = sessions.frames_in_segments_stream(frames, segments, "30 minutes", "1 hour", "1 hour")
    got = worked_off(spark, df, tmp_path)
    assert sorted((r.video_id, r.frame_id, r.seg) for r in got.collect()) == [(1, 1, 2), (1, 2, 1), (1, 2, 2), (1, 3, 1), (1, 3, 2)]
