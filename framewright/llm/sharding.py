"""Shards of near equal bytes from groups that stay whole: Karmarkar-Karp differencing.

Rows with equal text are one group.  Groups are dealt by hash to buckets of bounded size.
In a bucket every group starts as a partial partition with one filled shard; the two partial
partitions with the largest spread are joined, fullest shard on emptiest, until one is left.
The buckets' partitions (``shards`` sums each) are joined in the same way by tasks, ``FAN`` at a
time and level by level, and give each bucket its order of shards.  Slots follow from counts:
rows are cut in pieces by a hash of their id, as many as the largest group needs, and running
sums over pieces, buckets and the nodes above them number the rows without a global sort.

A group larger than a shard's share is kept whole, so its shard is as large as the group.
Null texts count as empty, have no bytes and checksum 0.  Rows without id are placed like
others.  Rows that repeat an id with an equal text share a shard and differ in their slot.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import partitions
from framewright.session import cut_lineage

BUCKET_GROUPS = 20_000
PIECE_ROWS = 5_000
FAN = 500
ROW_OVERHEAD = 16


def difference(partials: list[tuple[np.ndarray, object]], shards: int) -> list[tuple[object, np.ndarray]]:
    """Shard of every part of every partial partition: (name, shard per part).

    ``partials`` are (sums, name) with ``shards`` sums each.  A join lays the ascending sums
    of one on the descending sums of the other; the tree of joins is walked back for places.
    """
    heap = []
    for k, (sums, _) in enumerate(partials):
        heap.append((-float(sums.max() - sums.min()), k, sums))
    heapq.heapify(heap)
    count = len(partials)
    joins: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        up, down = np.argsort(x, kind="stable"), np.argsort(-y, kind="stable")
        total = x[up] + y[down]
        joins.append((a, up, b, down))
        heapq.heappush(heap, (-float(total.max() - total.min()), count + len(joins) - 1, total))
    place: dict[int, np.ndarray] = {count + len(joins) - 1 if joins else 0: np.arange(shards)}
    for k in range(len(joins) - 1, -1, -1):
        a, up, b, down = joins[k]
        here = place.pop(count + k)
        for child, order in ((a, up), (b, down)):
            where = np.empty(shards, np.int64)
            where[order] = here
            place[child] = where
    return [(name, place[k]) for k, (_, name) in enumerate(partials)]


def _bucket(shards: int):
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "same"], ascending=[False, True], kind="stable")
        partials = []
        for k, size in enumerate(rows["bytes"].tolist()):
            sums = np.zeros(shards)
            sums[0] = size
            partials.append((sums, k))
        at = [int(where[0]) for _, where in difference(partials, shards)]
        return rows.assign(part=np.array(at, np.int32))[["bucket", "same", "bytes", "part"]]
    return kernel


def _node(shards: int):
    """Joins the partitions of the children of one node: places of each, and the node's sums."""
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child")
        partials = [(np.array(s, float), k) for k, s in enumerate(rows["sums"])]
        places = [where for _, where in difference(partials, shards)]
        total = np.zeros(shards)
        for (sums, _), where in zip(partials, places):
            total[where] += sums
        return pd.DataFrame({"node": rows["node"], "child": rows["child"], "places": [w.tolist() for w in places],
                             "sums": [total.astype(np.int64).tolist()] + [None] * (len(rows) - 1)})
    return kernel


def _shards_of(local: DataFrame, buckets: int, shards: int, fan: int) -> DataFrame:
    """(bucket, node, part, shard): the tree of joins from the buckets up, walked back down."""
    sums = [F.sum(F.when(F.col("part") == k, F.col("bytes")).otherwise(0)) for k in range(shards)]
    level = local.groupBy(F.col("bucket").alias("child")).agg(F.array(*sums).alias("sums"))
    out, left = None, buckets
    while out is None or left > 1:
        joined = cut_lineage(level.withColumn("node", F.floor(F.col("child") / fan).cast("int")).groupBy("node").applyInPandas(
            _node(shards), "node int, child int, places array<int>, sums array<long>"))
        if out is None:
            out = joined.select(F.col("child").alias("bucket"), "node", F.col("node").alias("up"), "places")
        else:
            above = joined.select(F.col("child").alias("up"), F.col("node").alias("next"), F.col("places").alias("above"))
            out = out.join(above, "up").select(
                "bucket", "node", F.col("next").alias("up"), F.transform("places", lambda p: F.get("above", p)).alias("places"))
        level = joined.where("sums is not null").select(F.col("node").alias("child"), "sums")
        left = -(-left // fan)
    return out.select("bucket", "node", F.posexplode("places").alias("part", "shard"))


def _before(of: list[str], by: str, name: str = "n"):
    """Sum of ``name`` over the rows before in the order of ``by``."""
    window = Window.partitionBy(*of).orderBy(*by.split()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(window), F.lit(0))


def balance(docs: DataFrame, shards: int = 40, bucket_groups: int = BUCKET_GROUPS, piece_rows: int = PIECE_ROWS, fan: int = FAN,
            key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) per row; slots of a shard are gapless from 0."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(whole) + ROW_OVERHEAD).cast("long").alias("size"),
                       F.crc32(whole).alias("text_crc32"), F.md5(whole).alias("same"))
    groups = cut_lineage(rows.groupBy("same").agg(F.count(F.lit(1)).alias("held"), F.sum("size").alias("bytes")))
    count, most = groups.agg(F.count(F.lit(1)), F.max("held")).first()
    buckets, cuts = max(1, -(-count // bucket_groups)), max(1, -(-(most or 0) // piece_rows))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("same"), F.lit(buckets)).cast("int"))
    local = dealt.select("bucket", "same", "bytes").groupBy("bucket").applyInPandas(
        _bucket(shards), "bucket int, same string, bytes long, part int")
    local = cut_lineage(local)
    shard_of = _shards_of(local, buckets, shards, fan)

    # Pieces of a group, groups of a part, parts of a node, nodes of a shard: offsets of each in the next.
    cut = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(cuts)).cast("int"))
    pieces = cut.groupBy("same", "piece").agg(F.count(F.lit(1)).alias("n")).join(local.select("same", "bucket", "part"), "same")
    pieces = pieces.withColumn("in_part", _before(["bucket", "part"], "same piece"))
    parts = pieces.groupBy("bucket", "part").agg(F.sum("n").alias("n")).join(shard_of, ["bucket", "part"])
    nodes = parts.groupBy("shard", "node").agg(F.sum("n").alias("n")).withColumn("before", _before(["shard"], "node")).drop("n")
    parts = parts.withColumn("in_node", _before(["shard", "node"], "bucket")).join(nodes, ["shard", "node"])
    starts = pieces.join(parts.select("bucket", "part", "shard", "in_node", "before"), ["bucket", "part"]).select(
        "same", "piece", "shard", (F.col("in_part") + F.col("in_node") + F.col("before")).alias("start"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("same", "piece").orderBy("doc_id")) - 1)
    return ranked.join(starts, ["same", "piece"]).select(
        F.col("doc_id").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
