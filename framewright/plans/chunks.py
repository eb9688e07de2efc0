"""Bounded collections: a document that may grow without limit is cut in parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.plans.ordered import number_rows

# Records one nested document may carry.
MAX_PART_RECORDS = 50_000


def collect_parts(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], record: Column, name: str,
    max_records: int = MAX_PART_RECORDS, at_most: int | None = None, position: Column | None = None,
) -> DataFrame:
    """Ordered ``ARRAY`` of records per group, in parts of at most ``max_records``.

    Nothing is dropped: part 0 holds records 1..max, part 1 the next, and so on.
    ``position`` gives 1, 2, 3... per group where the rows already know theirs.
    """
    if position is None:
        numbered = number_rows(df, group, order, "_rn", at_most=at_most)
    else:
        numbered = df.withColumn("_rn", position.cast("long"))
    part = F.floor((F.col("_rn") - 1) / F.lit(max_records)).cast("int").alias("part")
    rows = numbered.select(*group, part, F.struct(F.col("_rn"), record.alias("r")).alias("_item"))
    packed = rows.groupBy(*group, "part").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    return packed.select(*group, "part", F.transform("_items", lambda i: i["r"]).alias(name))
