"""Duplicate drop: blocks of any size give the sequential walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.fixtures import views
from framewright.functions.pixels import near_identical
from framewright.operators import frames as R
from framewright.schemas import FRAMES


def brute(rows, hi=512, lo=192, frac=0.3, carried=None):
    last = {v: np.frombuffer(px, np.uint8).reshape(h, w) for v, h, w, px in carried or []}
    kept = set()
    for r in sorted(rows, key=lambda r: (r.video_id, r.pts_s, r.frame_id)):
        image = np.frombuffer(r.px, np.uint8).reshape(r.height, r.width)
        before = last.get(r.video_id)
        if before is None or not near_identical(image[None], before, hi, lo, frac)[0]:
            last[r.video_id] = image
            kept.add((r.video_id, r.frame_id))
    return kept


@pytest.fixture(scope="module")
def clip(spark):
    """Random walks of gray level; one video holds over a third of all frames, sizes differ."""
    rng, rows = random.Random(5), []
    for video, n in ((1, 180), (2, 60), (3, 1), (4, 90), (5, 40)):
        side, level = (16 if video % 2 else 24), 100
        for i in range(n):
            level = max(0, min(250, level + rng.choice((-3, -1, 0, 0, 1, 3))))
            px = np.full((side, side), level, np.uint8)
            if rng.random() < 0.1:
                px[:8, :8] = 255
            rows.append((video, video * 1000 + i, float(i), side, side, px.tobytes()))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, FRAMES)


def ids(df):
    return {(r.video_id, r.frame_id) for r in df.select("video_id", "frame_id").collect()}


@pytest.mark.parametrize("block", [45, 1000])
def test_blocks_equal_the_walk(clip, block):
    want = brute(clip.collect())
    assert ids(R.drop_near_duplicates(clip, frames_per_block=block)) == want


def test_chains_that_never_meet_are_streamed(clip, monkeypatch):
    monkeypatch.setattr(R, "MAX_ROUNDS", 1)
    assert ids(R.drop_near_duplicates(clip, frames_per_block=20)) == brute(clip.collect())


def test_hot_video_route(clip):
    assert ids(R.drop_near_duplicates(clip, frames_per_block=60, max_group_rows=30)) == brute(clip.collect())


@pytest.mark.parametrize("block", [60, 1000])
def test_carried_frame_enters_the_first_block(spark, clip, block):
    first = clip.where("pts_s < 20")
    rest = clip.where("pts_s >= 20")
    rows = [r for r in first.collect()]
    kept = brute(rows)
    last = {}
    for r in sorted(rows, key=lambda r: r.pts_s):
        if (r.video_id, r.frame_id) in kept:
            last[r.video_id] = r
    carried = spark.createDataFrame([tuple(r) for r in last.values()], FRAMES)
    got = ids(R.drop_near_duplicates(rest, carried=carried, frames_per_block=block))
    assert got == brute(clip.collect()) - kept


def test_options_per_video(spark, clip):
    options = spark.createDataFrame(
        [(1, True, 700, 64, 0.2, None, None, None), (2, True, None, None, None, None, 120.0, 0.5), (3, False, None, None, None, 0.0, -1.0, 0.0),
         (4, False, None, None, None, 0.5, None, 0.25), (5, True, 64, 64, 0.0, None, None, None)],
        "video_id long, drop_duplicates boolean, hi int, lo int, frac double, scene_threshold double, min_luma double, fps double")
    rich = clip.withColumns({"scene": (F.col("frame_id") % 3) / 3, "y_avg": (F.col("frame_id") % 200).cast("double")})
    for block in (60, 1000):
        got = ids(R.select_by_options(rich.join(options, "video_id"), frames_per_block=block))
        want = set()
        for o in options.collect():
            one = rich.where(F.col("video_id") == o.video_id)
            want |= ids(R.select_frames(one, o.scene_threshold, o.min_luma, o.drop_duplicates, o.fps,
                                        **({"hi": o.hi, "lo": o.lo, "frac": o.frac} if o.hi else {})))
        assert got == want


def test_text_keys(clip):
    named = clip.withColumn("video_id", F.concat(F.lit("v"), F.col("video_id").cast("string")))
    got = {(int(v[1:]), f) for v, f in ids(R.drop_near_duplicates(named, frames_per_block=60))}
    assert got == brute(clip.collect())


def test_columns_survive(clip):
    assert R.drop_near_duplicates(clip.withColumn("extra", F.lit(1)), frames_per_block=90).columns == [*clip.columns, "extra"]


def test_segment_rules(spark):
    s = spark.createDataFrame([(1, 5, 9), (2, 9, 5), (3, -1, 5), (4, 7, -1), (5, 3, 3)], "seg int, start_s int, end_s int")
    assert {r.seg for r in R.valid_segments(s).collect()} == {1, 3, 4, 5}


def test_known_fixture_counts(spark):
    sf = "/root/testdata/sf0.01"
    assert views.frames(spark, sf).where(R.scene_change()).count() == 7900
    assert views.frames(spark, sf).where(R.bright()).count() == 4477
    assert R.frames_in_segments(views.frames(spark, sf), views.segments(spark, sf), 5000.0).count() == 5476


def test_drop_count_lines(spark):
    lines = ["x drop_count:12", "drop_count: 7 y", "drop_count", "drop_count:", "drop_count: -3", "frame=9"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, line string")
    assert [r.n for r in df.select("i", R.drop_increment().alias("n")).orderBy("i").collect()] == [12, 7, 0, 0, 0, 0]
