"""Equi-joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.session import cut_lineage

# Rows of one key that a single join task may hold.
MAX_KEY_ROWS = 2_000_000
# Bytes of a counted table that may be shipped to every executor.
MAX_BROADCAST_BYTES = 8 << 20


def row_bytes(schema: T.StructType) -> int:
    """Rough width of a row: numbers 8, texts 32, anything that may be long 256."""
    narrow = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    return 16 + sum(8 if isinstance(f.dataType, narrow) else 32 if isinstance(f.dataType, T.StringType) else 256 for f in schema)


def fits_broadcast(rows: int, schema: T.StructType) -> bool:
    return rows * row_bytes(schema) <= MAX_BROADCAST_BYTES


def hot_keys(df: DataFrame, on: Sequence[str], max_rows: int) -> DataFrame:
    """Keys above ``max_rows`` with the number of salts each one gets."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    return counts.select(*on, F.ceil(F.col("_n") / max_rows).cast("int").alias("_salts"), "_n")


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
    salt_by: Sequence[str] | None = None, max_key_rows: int = MAX_KEY_ROWS, at_most: int | None = None,
    wide_right: bool = False,
) -> DataFrame:
    """Join that spreads hot left keys over several tasks.

    Where a key is hot and the right side is counted small, it is broadcast and the
    left side stays where it is.  Otherwise right rows of a hot key are repeated once
    per salt; other keys keep salt 0, so the right side grows only by its hot rows.  ``how`` must keep left rows
    on their own task: inner, left, left_semi or left_anti.  ``at_most`` bounds the
    left rows of a key where that is known; a small enough bound needs no counting.
    ``wide_right`` says that right rows hold pixels and are never broadcast.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not salted: {how}")
    if at_most is not None and at_most <= max_key_rows:
        return left.join(right, list(on), how)
    # The hot keys stay a table: however many there are, all of them are salted.
    hot = cut_lineage(hot_keys(left, on, max_key_rows).drop("_n"))
    if hot.isEmpty():
        return left.join(right, list(on), how)
    most = MAX_BROADCAST_BYTES // row_bytes(right.schema)
    if not wide_right and fits_broadcast(right.limit(most + 1).count(), right.schema):
        return left.join(F.broadcast(right), list(on), how)
    spread = F.pmod(F.xxhash64(*(salt_by or left.columns)), F.col("_salts"))
    salted = left.join(hot, list(on), "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(spread).cast("int")).drop("_salts")
    copies = right.join(hot, list(on), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
