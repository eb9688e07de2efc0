"""Point-in-interval joins through fixed-width buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.plans.skew import fits_broadcast
from framewright.session import cut_lineage


def interval_join(
    points: DataFrame, spans: DataFrame, on: Sequence[str], point: str, start: str, end: str, width: float,
) -> DataFrame:
    """Inner join ``start <= point <= end`` (both ends included) on equal keys.

    A span is repeated once per bucket it touches and a point lies in exactly one
    bucket, so the join is an equi-join, a pair appears once, and the points of
    one hot key spread over its buckets.
    """
    def bucket(c):
        return F.floor(F.col(c) / F.lit(float(width))).cast("long")

    p = points.withColumn("_bucket", bucket(point))
    # Kept once: both the count and the join read the spans, which may be dear to make.
    sound = cut_lineage(spans.where(F.col(start) <= F.col(end)))
    n = sound.agg(F.sum(bucket(end) - bucket(start) + 1)).first()[0] or 0
    s = sound.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    # The optimizer cannot see how far the spans expand, so the count decides.
    s = F.broadcast(s) if fits_broadcast(n, s.schema) else s.hint("merge")
    return (
        p.join(s, [*on, "_bucket"])
        .where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end)))
        .drop("_bucket")
    )
