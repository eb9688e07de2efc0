"""The hot-group routes give what the plain ones give."""

import pytest
from pyspark.sql import functions as F

from framewright.plans.chunks import collect_parts
from framewright.plans.ordered import number_rows, previous_row, running_sum
from framewright.plans.ranges import interval_join
from framewright.plans.skew import salted_join
from framewright.plans.spread import spread


@pytest.fixture(scope="module")
def rows(spark):
    """Group 0 holds a third of the rows; one group key is null; values repeat."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 101 == 1, F.lit(None)).otherwise(F.col("id") % 17 + 1)
    return spark.range(3000).select(
        key.alias("g"), (F.xxhash64("id") % 500).alias("v"), F.col("id").alias("tie"), (F.col("id") % 5).alias("n"))


def same(a, b):
    cols = a.columns
    return sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))


@pytest.mark.parametrize("group", [["g"], []])
def test_tiles_number_like_one_window(rows, group):
    assert same(number_rows(rows, group, ["v", "tie"]), number_rows(rows, group, ["v", "tie"], max_group_rows=10))


@pytest.mark.parametrize("group", [["g"], []])
def test_tiles_see_the_previous_row(rows, group):
    nullable = rows.withColumn("v", F.when(F.col("v") % 7 != 0, F.col("v")))
    args = (group, [F.col("v").desc(), "tie"], {"before": "v", "before_tie": "tie"})
    assert same(previous_row(nullable, *args), previous_row(nullable, *args, max_group_rows=10))


@pytest.mark.parametrize("group", [["g"], []])
def test_tiles_sum_like_one_window(rows, group):
    args = (group, ["v", "tie"], "n", "total")
    assert same(running_sum(rows, *args), running_sum(rows, *args, max_group_rows=10))


def test_a_bound_saves_the_count_and_changes_nothing(rows):
    assert same(number_rows(rows, ["g"], ["v", "tie"]), number_rows(rows, ["g"], ["v", "tie"], at_most=3000))


@pytest.mark.parametrize("small", [0, 200_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how, small, monkeypatch):
    monkeypatch.setattr("framewright.plans.skew.MAX_BROADCAST_BYTES", small * 1000)
    right = spark.range(0, 12).select(F.col("id").alias("g"), (F.col("id") * 10).alias("w"))
    plain = rows.join(right, ["g"], how)
    assert same(plain, salted_join(rows, right, ["g"], how, max_key_rows=100))


@pytest.mark.parametrize("small", [0, 200_000])
def test_interval_join_has_both_ends_and_no_repeats(spark, small, monkeypatch):
    monkeypatch.setattr("framewright.plans.skew.MAX_BROADCAST_BYTES", small * 1000)
    points = spark.range(200).select((F.col("id") % 2).alias("k"), (F.col("id") / 2).alias("t"))
    spans = spark.createDataFrame([(0, 3.0, 40.0), (0, 40.0, 40.0), (1, 7.5, 7.5), (1, -5.0, 500.0), (1, 9.0, 8.0)], "k long, a double, b double")
    brute = points.join(spans, "k").where((F.col("t") >= F.col("a")) & (F.col("t") <= F.col("b")))
    for width in (0.7, 10.0, 1000.0):
        assert same(brute, interval_join(points, spans, ["k"], "t", "a", "b", width))


def test_parts_are_bounded_and_whole(rows):
    parts = collect_parts(rows, ["g"], ["v", "tie"], F.col("tie"), "ties", 64)
    assert parts.agg(F.max(F.size("ties"))).first()[0] == 64
    ordered = number_rows(rows, ["g"], ["v", "tie"])
    back = parts.select("g", "part", F.posexplode("ties").alias("p", "tie")).select(
        "g", (F.col("part") * 64 + F.col("p") + 1).cast("long").alias("rn"), "tie")
    assert same(ordered.select("g", "rn", "tie"), back)


def test_spread_only_widens_small_scans(spark, sf):
    small = spark.read.parquet(f"{sf}/events.parquet")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 50)
    assert spread(wide) is wide


def test_kernels_run_once_per_row(spark, sf):
    from framewright.fixtures import views
    from framewright.operators import curation, volumes
    decided = curation.decide(curation.measure(views.thumbs(spark, sf)))
    projected = volumes.project(views.voxel_slices(spark, sf))
    for df, name in ((decided, "image_measures("), (projected, "normalised_voxels(")):
        assert df._jdf.queryExecution().executedPlan().toString().count(f"ArrowEvalPython [{name}") == 1


def test_global_numbers_plan_no_single_partition(rows):
    out = number_rows(rows, [], ["v", "tie"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Only the per-tile summary, one row per tile, is brought to one task.
    assert plan.count("SinglePartition") <= 1


def test_a_spread_scan_bounds_the_rows_of_a_task(spark, tmp_path, monkeypatch):
    from framewright.plans import spread as P
    spark.range(10_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(P, "MAX_TASK_ROWS", 500)
    sizes = P.spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 520 and sum(r["count"] for r in sizes) == 10_000


def test_numbers_without_a_group_leave_the_rows_where_they_are(spark):
    """The summary of the tiles is a row per tile: no second shuffle of all rows joins it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5_000).selectExpr("id", "(id * 7919) % 5000 as o")
        out = number_rows(rows, [], ["o"], "n", max_group_rows=700, at_most=5_000)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert out.where("n <> o + 1").count() == 0 and out.count() == 5_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
