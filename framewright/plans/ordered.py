"""Ordered computations that survive a hot group.

``row_number``, ``lag`` and running sums need their group in one sorted task.
Here a group that is too large for one task is cut into *tiles*: the rows are
range-partitioned on (group, order), each tile is handled on its own, and the
per-tile summaries (at most one row per group and tile) supply what crosses a
tile edge.  Results are the same on both routes.

The choice needs the size of the largest group.  ``at_most``, a bound on the
rows that the caller knows cheaply (a file's row count, say), saves counting it.
Rows without a group are one group however many they are, so they are always tiled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut_lineage

# Rows of one group that a single sorted task may hold.
MAX_GROUP_ROWS = 1_000_000

_POSITION_MASK = (1 << 33) - 1


def group_sizes(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """Rows in the largest group and in all; a pre-aggregated count of the keys alone."""
    if not group:
        n = df.count()
        return n, n
    top, total = df.groupBy(*group).count().agg(F.max("count"), F.sum("count")).first()
    return top or 0, total or 0


def tiles_needed(df: DataFrame, group: Sequence[str], limit: int, at_most: int | None) -> int:
    """0 where every group fits one task, by a known bound or by counting; else how many
    tiles to cut, so that a tile holds about ``limit`` rows or fewer.  Without a group there
    are tiles at every size."""
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not group:
        return max(cores, -(-(df.count() if at_most is None else at_most) // limit))
    if at_most is not None and at_most <= limit:
        return 0
    largest, total = group_sizes(df, group)
    if largest <= limit:
        return 0
    return max(cores, -(-total // limit))


def _order(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _tiles(df: DataFrame, group: Sequence[str], order: list[Column], n: int) -> DataFrame:
    """Rows in global (group, order) sequence with `_tile` and the position in it."""
    keys = [F.col(g) for g in group] + order
    tiled = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__tile", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    # Range bounds come from a sample: all reads must see one tiling.
    return cut_lineage(tiled)


def _attach(tiled: DataFrame, summary: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null-safe join of per-(group, tile) values back to the rows.

    Without a group the summary has a row per tile, so it is sent to the rows, which stay
    where they are."""
    keys = [*group, "__tile"]
    if not group:
        summary = F.broadcast(summary)
    right = summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    on = [tiled[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = tiled.join(right, on, "left")
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def _before(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rn",
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Gap-free 1..n per group in the given total order."""
    order = _order(order)
    n = tiles_needed(df, group, max_group_rows, at_most)
    if not n:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    tiled = _tiles(df, group, order, n)
    spans = tiled.groupBy(*group, "__tile").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    spans = spans.withColumn("__offset", F.coalesce(F.sum("__n").over(_before(group)), F.lit(0)))
    out = _attach(tiled, spans, group, ["__first", "__offset"])
    return out.withColumn(name, (F.col("__pos") - F.col("__first") + F.col("__offset") + 1).cast("long")).drop(
        "__tile", "__pos", "__first", "__offset")


def previous_row(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], columns: dict[str, str],
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Add ``new <- old of the row before`` per group; null on the first row."""
    order = _order(order)
    n = tiles_needed(df, group, max_group_rows, at_most)
    if not n:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
    tiled = _tiles(df, group, order, n)
    packed = F.struct(*columns.values())
    last = tiled.groupBy(*group, "__tile").agg(F.max_by(packed, "__pos").alias("__last"))
    edges = last.withColumn("__edge", F.lag("__last").over(Window.partitionBy(*group).orderBy("__tile")))
    inside = Window.partitionBy(*group, "__tile").orderBy("__pos")
    rows = _attach(tiled.withColumn("__prev", F.lag(packed).over(inside)), edges, group, ["__edge"])
    before = F.coalesce("__prev", "__edge")
    return rows.withColumns({new: before[old] for new, old in columns.items()}).drop(
        "__tile", "__pos", "__prev", "__edge")


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str, name: str,
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per group in the given total order."""
    order = _order(order)
    n = tiles_needed(df, group, max_group_rows, at_most)
    if not n:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    tiled = _tiles(df, group, order, n)
    totals = tiled.groupBy(*group, "__tile").agg(F.sum(value).alias("__total"))
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(_before(group)), F.lit(0)))
    inside = Window.partitionBy(*group, "__tile").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _attach(tiled.withColumn("__local", F.sum(value).over(inside)), totals, group, ["__offset"])
    return rows.withColumn(name, F.col("__local") + F.col("__offset")).drop("__tile", "__pos", "__local", "__offset")
