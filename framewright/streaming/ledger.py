"""Restartable batches: finished manifests are kept in a ledger table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.catalog import pending

LEDGER = "path string, finished_at timestamp"


def finished(spark: SparkSession, ledger: str) -> DataFrame:
    """Paths done so far; an absent ledger is an empty one."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(ledger)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def run_pending(
    manifests: DataFrame, ledger: str, work: Callable[[DataFrame], DataFrame], force: bool = False,
) -> DataFrame:
    """Run ``work`` on manifests that are not in the ledger, then enter them.

    ``work`` returns the ``path`` of each manifest it finished; a failed one is
    left out and comes back with the next run.
    """
    spark = manifests.sparkSession
    todo = pending(manifests, finished(spark, ledger), force=force)
    done = work(todo).select("path", F.current_timestamp().alias("finished_at"))
    done.write.mode("append").parquet(ledger)
    return finished(spark, ledger)
