"""Nested reports."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import crops as C
from framewright.operators import frames as R
from framewright.operators import reports as Q
from framewright.operators import rotation
from framewright.operators import volumes as O
from framewright.schemas import EXTRACTION_OPTIONS


def test_session_report_parts_repeat_totals(spark):
    crops = spark.range(30).select((F.col("id") % 3 + 1).cast("int").alias("w"), F.lit(5).alias("h"))
    metrics = C.size_metrics(crops, 0.2)
    whole = Q.session_report(metrics, "t", 0.2, "p", "u").collect()
    assert len(whole) == 1 and whole[0].totals.overall == 30 and set(whole[0].by_size) == {"1x5", "2x5", "3x5"}
    assert whole[0].by_size["1x5"].perMinute == 600.0 and whole[0].session.durationSeconds == 1
    parts = Q.session_report(metrics, "t", 0.2, "p", "u", 2).collect()
    assert sorted(len(p.by_size) for p in parts) == [1, 2] and all(p.totals.overall == 30 for p in parts)


def test_segment_parts_go_on_counting(spark):
    s = spark.createDataFrame([(1, i, i, i + 1, "F") for i in range(1, 6)], "video_id long, seg int, start_s int, end_s int, prefix string")
    docs = Q.segment_documents(s, 2).orderBy("part").collect()
    assert [sorted(d.segments) for d in docs] == [["segment_1", "segment_2"], ["segment_3", "segment_4"], ["segment_5"]]
    assert docs[2].segments["segment_5"].start == 5


def test_rates_of_nothing_are_zero(spark):
    runs = spark.createDataFrame([(0, 0, 0.0, 0.0, 0, 0)], "frames int, dropped int, duration_s double, elapsed_s double, source_bytes long, frame_bytes long")
    r = R.extraction_rates(runs).first()
    assert (r.frames_per_second, r.processing_rate, r.duplicate_rate, r.real_time_factor, r.compression_ratio) == (0, 0, 0, 0, None)


def test_mode_checks(spark):
    h = spark.createDataFrame([("a", [1, 5, 1, 1]), ("b", [2, 5, 6, 1]), ("c", [4, 5, 6, 7])], "path string, dim array<smallint>")
    assert [r.skip_reason is None for r in O.mode_check(h, None).orderBy("path").collect()] == [False, True, True]
    assert [r.skip_reason is None for r in O.mode_check(h, 2).orderBy("path").collect()] == [False, False, True]
    views = {(r.path, r.view): (r.n_slices, r.slice_w, r.slice_h) for r in O.views_of(h).collect()}
    assert views == {("b", "axial"): (6, 5, 1), ("c", "axial"): (7, 5, 6), ("c", "coronal"): (6, 5, 7), ("c", "sagittal"): (5, 6, 7)}


def test_counters_of_an_incomplete_manifest(spark):
    m = spark.createDataFrame([(1, False, True), (2, True, True), (3, False, False), (4, False, True)], "manifest_id int, done boolean, has_crops boolean")
    o = spark.createDataFrame([(1, 10, 5, "done"), (1, 10, 5, "out of bounds"), (1, 11, None, "no image"), (2, 10, 5, "done"), (4, 10, 5, "done"), (4, 10, 5, "incomplete")],
                              "manifest_id int, image_id int, image_width int, outcome string")
    assert tuple(C.batch_counters(m, o).first()) == (4, 1, 1, 2, 1, 5, 1, 2)
    assert tuple(C.batch_counters(m, o, force=True).first()) == (4, 2, 0, 2, 2, 6, 2, 2)


def test_level_names(spark):
    df = spark.createDataFrame([(64, 32, False), (32, 16, False), (16, 8, False), (9, 9, False), (9, 9, True)], "w int, h int, p boolean")
    got = [r.l for r in df.select(C.level_name("w", "h", F.lit(64), F.lit(32), "p").alias("l")).collect()]
    assert got == ["primary", "secondary", "tertiary", None, "primary"]


def test_filter_strings(spark):
    rows = [
        (1, (True, None, True, 600, None, 0.25, True, 2.0, True, 0.02, True, 20.5)),
        (2, (True, None, False, 600, 1, 0.25, False, 2.0, False, 0.02, False, 20.0)),
        (3, (False, None, True, 600, 1, 0.25, True, 0.0, True, -1.0, None, 20.0)),
        (4, (None, None, None, None, None, None, None, None, None, None, None, None)),
        (5, (True, None, True, None, None, None, True, 29.97, False, None, True, None)),
        (6, None),
    ]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("o", EXTRACTION_OPTIONS)]))
    got = {r.id: r.t for r in df.select("id", Q.filter_string(F.col("o")).alias("t")).collect()}
    assert got == {
        1: "select=gt(scene\\,0.02),signalstats,select=gt(metadata('lavfi.signalstats.YAVG')\\,20.5),mpdecimate=hi=600:frac=0.25,fps=2",
        2: "mpdecimate", 3: None, 4: None, 5: "mpdecimate,fps=29.97", 6: None}


def test_a_report_without_exports_and_a_plan_in_parts(spark):
    none = spark.createDataFrame([], "path string, name string, dim array<int>, axis int, view string, n_exported long, n_low_quality long, "
                                     "type_name string, length long, skip_reason string")
    r = Q.volume_report(none, F.col("name"), "/a", "/b", 0, "t", "s", "p", "u").collect()
    assert len(r) == 1 and (r[0].totalFilesProcessed, r[0].exportSequence, r[0].exports, r[0].filesProcessedPerSecond) == (0, 0, [], 0.0)
    images = spark.createDataFrame([(1, "/i/a.png", 1000, 800), (2, "/i/b.png", 50, 40)], "image_id long, path string, width int, height int")
    regions = rotation.tile_regions(rotation.with_angles(images, (0, 30)), 256, 256)
    docs = Q.rotation_documents(images, regions, 256, 256, (0, 30), "now", max_records=10).orderBy("image_id", "part").collect()
    held = [(d.image_id, d.part, [(a.angle, len(a.cropRegions)) for a in d.angles]) for d in docs]
    assert [h for h in held if h[0] == 1] == [(1, 0, [(0, 10), (30, 10)]), (1, 1, [(0, 10), (30, 6)]), (1, 2, [(0, 10)]), (1, 3, [(0, 6)])]
    small = [d for d in docs if d.image_id == 2]  # no room for a region: the angles are listed all the same
    assert len(small) == 1 and [(a.angle, a.cropRegions) for a in small[0].angles] == [(0, []), (30, [])]
    assert set(small[0].angles[0].geometricParameters) >= {"h", "x1", "ymax"} and docs[0]["Image path"] == "/i/a.png"


def test_regions_are_laid_in_the_rows_that_hold_them(spark):
    sizes = [(1, 1000, 800), (2, 50, 40), (3, 700, 300), (4, 257, 256), (5, 256, 1000)]
    images = spark.createDataFrame([(i, f"/i/{i}.png", w, h) for i, w, h in sizes], "image_id long, path string, width int, height int")
    angles = (0, 30, 45, 60, 90)
    regions = rotation.tile_regions(rotation.with_angles(images, angles), 256, 256)
    for most in (3, 10, 50_000):
        given, laid = (Q.rotation_documents(images, r, 256, 256, angles, "now", max_records=most) for r in (regions, None))
        order = ["image_id", "part"]
        assert laid.schema.simpleString() == given.schema.simpleString()
        assert laid.orderBy(*order).collect() == given.orderBy(*order).collect()
        plans = Q.rotation_plans_of(images, 256, 256, angles, most)
        key = ["image_id", "angle", "part"]
        assert plans.orderBy(*key).collect() == Q.rotation_plans(regions, most).select(plans.columns).orderBy(*key).collect()
    assert "Exchange" not in plans._jdf.queryExecution().executedPlan().toString()
    # Regions are made above the one shuffle of a document, which carries geometry only.
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "cropRegions" not in plan[plan.index("Exchange"):]
