"""What the operators of this subpackage share: reading, batch bounds, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import cut_lineage, ensure_checkpoint_dir

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Edges that a task of a round of ``components`` takes.
TASK_EDGES = 100_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, for tables between steps."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hold the rows of an Arrow batch down while wide rows pass; only for eager work."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def bound_text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts of 100 KB are common: let no Arrow batch hold more than ``rows`` of them."""
    before = int(spark.conf.get(_BATCH))
    if before <= 0 or before > rows:
        spark.conf.set(_BATCH, str(rows))


def give_back() -> None:
    """Hand freed memory back to the machine: idle Python workers stay next to the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(kernel: Callable) -> Callable:
    """An Arrow kernel that gives its memory back when its partition is done."""
    def run(batches):
        yield from kernel(batches)
        give_back()
    return run


def labelled_sample(
    labels: DataFrame, docs: DataFrame, label: str, usable: Column, max_rows: int, key: str, text: str,
) -> DataFrame:
    """(_id, label, text) of at most ``max_rows`` labelled documents, those with the smallest
    hash of their id; that bound is what makes the id list safe to ship to the scan."""
    picked = labels.where(usable & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows)
    source = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    return source.join(F.broadcast(picked), "_id").select("_id", "label", "text")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component = smallest node).

    Alternating large-star and small-star steps until nothing moves.  Minima are partial
    aggregates and are joined back to the edges, so a node with many neighbours is never
    gathered; self-loops, repeated edges and nulls are ignored.  Every round is cut by a
    reliable checkpoint and has as many tasks as its edges need, not as the session's
    shuffles have: files of the rounds stay on disk until the driver collects its garbage.
    No edge gives no row.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = cut_lineage(e)
    tasks = max(1, -(-e.count() // TASK_EDGES))
    e = e.coalesce(tasks)

    def pairs(*ends: tuple[str, str]) -> Column:
        return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends]))
    seen = None
    while True:
        # Large star: neighbours above a node move to the smallest of its neighbourhood.
        low = e.select(pairs(("u", "v"), ("v", "u"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u")
        large = big.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        # Small star: a node and its lower neighbours move to the lowest of them.
        hung = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").coalesce(tasks)
        e = cut_lineage(hung.select(pairs(("v", "m"), ("u", "m"))).where("u <> v").distinct().coalesce(tasks))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")),
                              F.struct(F.col("v").alias("node"), F.col("v").alias("component"))))
    return e.select(roots.alias("_n")).select("_n.*").distinct()
