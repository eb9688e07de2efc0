"""Give a scan with too few splits enough tasks for the work that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Rows of a spread scan that one task takes.
MAX_TASK_ROWS = 1_000_000


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a bare file scan that has fewer splits than the cluster has cores.

    One small file (or one row group) is one task, however much each row then
    expands, so rows are dealt over all cores, and over more tasks where a core's share
    would be above ``MAX_TASK_ROWS``.  A scan with enough splits, which any large table has, is returned
    as it is, so no shuffle is added where data is big.  For scans only: asking
    any other plan for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return in_tasks(scan, scan.count()) if scan.rdd.getNumPartitions() < cores else scan


def in_tasks(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows dealt over all cores, at most ``MAX_TASK_ROWS`` to a task, whatever their keys."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-n // MAX_TASK_ROWS)))
