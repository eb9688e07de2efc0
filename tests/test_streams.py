"""Streams give what their batch twins give."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.fixtures import views as V
from framewright.operators import curation as U
from framewright.operators import frames as R
from framewright.operators import similarity as S
from framewright.schemas import FRAMES
from framewright.sinks.png import png_bytes
from framewright.streaming import autoexport, frames, ingest, ledger


def staged(spark, df, path, order, files=3):
    """Write rows in order as a few files and stream them one file per batch."""
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * step:(i + 1) * step]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def key_rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_near_duplicate_drop(spark, sf, tmp_path):
    clip = V.pixel_frames(spark, sf).select("video_id", "frame_id", "pts_s", "height", "width", "px")
    stream = staged(spark, clip, str(tmp_path / "in"), ["pts_s", "frame_id"])
    q = frames.drop_near_duplicates_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    assert key_rows(got, "video_id", "frame_id") == key_rows(R.drop_near_duplicates(clip), "video_id", "frame_id")


def test_a_frame_stream_starts_from_a_batch_result(spark, tmp_path):
    """Batch over the first part, stream over the rest, equal to a batch over all; sizes change on the way."""
    rng = np.random.default_rng(2)
    rows = []
    for v in range(4):
        scene = rng.integers(0, 256, (16, 16), dtype=np.uint8)
        for i in range(30):
            if rng.random() < 0.3:
                scene = rng.integers(0, 256, (16, 16), dtype=np.uint8)
            rows.append((v, i, i / 10, 16, 16, bytes(np.clip(scene.astype(int) + rng.integers(-2, 3, (16, 16)), 0, 255).astype(np.uint8))))
    clip = spark.createDataFrame(rows, FRAMES)
    early, late = clip.where("pts_s < 1.5"), clip.where("pts_s >= 1.5")
    first = R.drop_near_duplicates(early)
    stream = staged(spark, late, str(tmp_path / "in"), ["pts_s", "frame_id"])
    q = frames.drop_near_duplicates_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), initial=first)
    q.awaitTermination(180)
    assert q.exception() is None
    got = key_rows(spark.read.parquet(str(tmp_path / "out")).unionByName(first), "video_id", "frame_id")
    assert got == key_rows(R.drop_near_duplicates(clip), "video_id", "frame_id") and len(got) < len(rows)
    more = spark.createDataFrame([(0, 99, 9.9, 8, 8, bytes(64)), (9, 1, 0.0, 8, 8, bytes(64)), (9, 2, 0.1, 8, 8, bytes(64))], FRAMES)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in"))
    frames.drop_near_duplicates_stream(again, str(tmp_path / "out"), str(tmp_path / "cp"), initial=first).awaitTermination(180)
    grown = key_rows(spark.read.parquet(str(tmp_path / "out")).unionByName(first), "video_id", "frame_id")
    assert grown == sorted(got + [(0, 99), (9, 1)])


def test_state_that_expires(spark, tmp_path):
    rows = [(1, i, float(i), 8, 8, bytes(64)) for i in range(3)] + [(2, 1, 0.0, 8, 8, bytes(64))]
    stream = staged(spark, spark.createDataFrame(rows, FRAMES), str(tmp_path / "in"), ["pts_s"], 1)
    args = (stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    with pytest.raises(ValueError):
        frames.drop_near_duplicates_stream(*args, ttl_ms=1000)
    q = frames.drop_near_duplicates_stream(*args, ttl_ms=1000, trigger={"processingTime": "1 second"})
    try:
        def kept():
            return key_rows(spark.read.schema(FRAMES).parquet(str(tmp_path / "out")), "video_id", "frame_id") if (tmp_path / "out" / "_spark_metadata").exists() else []
        for want in ([(1, 0), (2, 1)], [(1, 0), (1, 9), (2, 1)]):
            for _ in range(120):
                if kept() == want:
                    break
                time.sleep(0.5)
            assert kept() == want and q.exception() is None
            time.sleep(1.5)  # what was kept is forgotten, so the same frame is kept again
            spark.createDataFrame([(1, 9, 9.0, 8, 8, bytes(64))], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    finally:
        q.stop()


def test_uniform_sampling_windows(spark, tmp_path):
    rows = spark.range(120).select((F.col("id") % 2).alias("video_id"), F.col("id").alias("frame_id"),
                                   F.timestamp_seconds(F.col("id") / 4).alias("ts"))
    stream = staged(spark, rows, str(tmp_path / "in"), ["ts", "frame_id"], 1)
    out = frames.sample_uniform_stream(stream, "2 seconds", "1 second")
    q = out.writeStream.format("memory").queryName("sampled").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = key_rows(spark.table("sampled"), "video_id", "frame_id")
    batch = R.sample_uniform(rows.select("video_id", "frame_id", F.col("ts").cast("double").alias("pts_s")), 0.5)
    want = key_rows(batch, "video_id", "frame_id")
    assert got and set(got) <= set(want) and len(want) - len(got) <= 2  # the last window is still open


def test_new_files_and_exact_copies(spark, tmp_path):
    root = tmp_path / "drop"
    root.mkdir()
    for i in range(6):
        px = np.full((3, 3), 10 + i % 2, np.uint8).tobytes()
        (root / f"f{i}.PNG").write_bytes(png_bytes(px, 3, 3, 1))
    (root / "note.txt").write_text("x")
    stream = ingest.drop_exact_copies(ingest.new_objects(spark, str(root), 2))

    def run():
        q = stream.select("path", "sha256").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 2
    (root / "later.png").write_bytes(png_bytes(bytes(9), 3, 3, 1))
    again = run()
    assert again.count() == 3 and again.select("sha256").distinct().count() == 3


def test_consecutive_distances(spark, sf, tmp_path):
    m = U.measure(V.thumbs(spark, sf)).select(F.col("folder").cast("string").alias("folder"), "name", "image_id", "dhash")
    stream = staged(spark, m, str(tmp_path / "in"), ["name"])
    q = ingest.consecutive_distances_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert q.exception() is None
    cols = ("folder", "a_image_id", "b_image_id", "distance")
    assert key_rows(spark.read.parquet(str(tmp_path / "out")), *cols) == key_rows(S.hash_distances(m), *cols)


def test_hash_distances_start_from_a_batch_result(spark, tmp_path):
    rows = [("f", "a.png", 1, 3), ("f", "B.png", 2, 7), ("f", "c.png", 3, -1), ("f", "d.png", 4, None), ("g", "a.png", 5, 0), ("g", "b.png", 6, 255)]
    m = spark.createDataFrame(rows, "folder string, name string, image_id long, dhash long")
    stream = staged(spark, m.where("image_id > 2"), str(tmp_path / "in"), ["name"], 1)
    q = ingest.consecutive_distances_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), initial=m.where("image_id = 2"))
    q.awaitTermination(120)
    got = key_rows(spark.read.parquet(str(tmp_path / "out")), "folder", "a_name", "b_name", "distance")
    assert got == [("f", "B.png", "c.png", 61), ("f", "c.png", "d.png", None), ("g", "a.png", "b.png", 8)]


def test_auto_export_fills_then_clears(spark, tmp_path):
    crops = spark.range(100).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("seq"), (F.col("id") % 5 != 0).alias("is_primary"))
    stream = staged(spark, crops, str(tmp_path / "in"), ["seq"], 4)
    q = autoexport.auto_export(stream, 7, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert q.exception() is None
    want = autoexport.export_sequences(crops, 7).where("export_sequence is not null")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert key_rows(got, "session_id", "export_sequence", "seq") == key_rows(want, "session_id", "export_sequence", "seq")
    assert got.groupBy("session_id", "export_sequence").agg(F.count_if("is_primary").alias("n")).where("n <> 7").count() == 0


def test_auto_export_goes_on_after_a_stop_and_takes_odd_rows(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "session_id long, seq long, is_primary boolean, note string"
    parts = [
        [(1, 2, True, "a"), (1, 1, True, None), (2, 1, None, "x"), (None, 1, True, "n")],
        [(1, 4, False, "late"), (1, 3, True, "b"), (1, 3, True, "b"), (2, 2, True, "y")],
        [(1, 5, True, "c"), (1, 6, True, "d"), (2, None, True, "z"), (2, 9, True, "w"), (None, 2, True, "m"), (None, 3, True, "o")],
    ]
    got = []
    for part in parts:  # one run of the query per part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        q = autoexport.auto_export(stream, 3, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        got.append(sorted((r.session_id or 0, r.export_sequence, r.seq or 0, r.note or "") for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got[0] == []
    assert got[1] == [(1, 1, 1, ""), (1, 1, 2, "a"), (1, 1, 3, "b")]
    # Session 1: the second b, the late crop behind it, then c and d; session 2: a crop without place goes first.
    assert got[2] == sorted(got[1] + [(1, 2, 3, "b"), (1, 2, 4, "late"), (1, 2, 5, "c"), (1, 2, 6, "d"), (2, 1, 0, "z"), (2, 1, 1, "x"), (2, 1, 2, "y"),
                                      (2, 1, 9, "w"), (0, 1, 1, "n"), (0, 1, 2, "m"), (0, 1, 3, "o")])


def test_export_numbers_on_the_hot_route(spark):
    crops = spark.range(300).select(F.lit(1).alias("session_id"), F.col("id").alias("seq"), (F.col("id") % 4 == 1).alias("is_primary"))
    cols = ("seq", "export_sequence")
    a, b = autoexport.export_sequences(crops, 10), autoexport.export_sequences(crops, 10, max_group_rows=20)
    assert sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


def test_ledger_restarts(spark, tmp_path):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    book = str(tmp_path / "ledger")
    seen = []

    def work(todo):
        seen.append({r.path for r in todo.collect()})
        return todo.where("path <> 'b'")

    ledger.run_pending(m, book, work)
    done = ledger.run_pending(m, book, work)
    assert seen == [{"a", "b", "c"}, {"b"}] and {r.path for r in done.collect()} == {"a", "c"}
    ledger.run_pending(m, book, work, force=True)
    assert seen[2] == {"a", "b", "c"}


def test_observed_counts(spark, sf, tmp_path):
    listener = ingest.ProgressListener()
    spark.streams.addListener(listener)
    try:
        m = U.measure(V.thumbs(spark, sf)).select("image_id", "var_laplacian", "mean_luma")
        stream = staged(spark, m, str(tmp_path / "in"), ["image_id"], 2)
        q = ingest.observed_decisions(U.decide(stream)).writeStream.format("noop").option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = U.decision_totals(U.decide(m)).first()
        for _ in range(50):
            if listener.totals.get("seen") == m.count():
                break
            __import__("time").sleep(0.1)
        assert (listener.totals["kept"], listener.totals["dropped"]) == tuple(want)
    finally:
        spark.streams.removeListener(listener)


def test_a_streamed_table_has_files_of_bounded_size(spark, tmp_path):
    from framewright.registry.streams import _streamed
    root, seen = str(tmp_path / "in"), []
    rows = _streamed(spark, spark.range(4_000), root, at_most=4_000, file_rows=200)
    sizes = spark.read.parquet(root).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 220
    rows.writeStream.foreachBatch(lambda b, _: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(seen) == 4_000


def test_stream_drop_writes_frames_once(spark, sf, monkeypatch):
    """No checkpoint of all frames beside the folder that the halves are read from."""
    from framewright.registry import streams
    cut, held = streams.cut_lineage, []

    def noted(df):
        held.append(set(df.columns))
        return cut(df)
    monkeypatch.setattr(streams, "cut_lineage", noted)
    streams.str1_stream(spark, sf)
    assert held and not any("_late" in c for c in held)
