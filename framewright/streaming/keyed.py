"""What streams with state per key share: the store they need and how they are started."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which reads and writes single keys:
    a batch costs what its own keys cost.  The session's setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def time_mode(ttl_ms: int | None, trigger: dict | None) -> str:
    """State that expires needs the clock, and with the clock a query always has a next batch:
    it must be given a trigger that goes on."""
    if ttl_ms is None:
        return "None"
    if not trigger or "processingTime" not in trigger:
        raise ValueError("state with a time-to-live needs a processingTime trigger")
    return "ProcessingTime"
