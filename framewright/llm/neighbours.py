"""Near-duplicate vectors by sorted projection passes.

A pass draws random hyperplanes, spells every vector as the concatenated signs of its
projections and sorts by that key.  Sorted vectors are cut in blocks of ``window`` rows, and
every vector is compared with its own block and the next one, so with at least ``window``
neighbours on either side; a pair is linked if its cosine, in double precision, reaches
``threshold``.  The links of all passes give the components.

Links are then counted inside the components, where every pair of members is compared, also
those that no pass brought together.  A component of more than one tile is ordered by its
place in the first pass and cut in tiles; a task holds one tile of it and one other at a
time, and tiles whose caps lie too far apart for any link are not compared.  No table of
pairs is made.

The number of passes follows from the number of vectors: where these fill the sign cells
evenly, a pair at the threshold meets with probability ``recall`` in at least one pass, which
grows with log(n / window) passes.  Crowded cells need more, which is measured: the passes
are doubled, with new hyperplanes, until the new half joins no more than ``1 - recall`` of
all that is joined.
Links are missed only where no chain of pairs that met joins the two vectors; none below the
threshold is linked.

Equal vectors are one class before the passes.  Vectors that are null, empty, zero or hold
null or non-finite components, or have another length than most, link with nothing.  Rows
without id give no row; rows that share an id and a vector count once each for others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import batches_of, components, partitions
from framewright.llm.jaccard import Groups
from framewright.plans.ordered import number_rows
from framewright.plans.skew import salted_join
from framewright.session import cut_lineage

BITS = 62
WINDOW = 512
# Keys of one pass that a single sorted task may hold.
TILE_ROWS = 20_000
# Bytes of the vectors of a tile of a component.
TILE_BYTES = 1 << 20
MAX_PASSES = 512  # a guard against windows far too small for the table; raises beyond it


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes until a pair at the threshold met with probability ``recall``: a pass keeps
    two vectors together while their first log2(n / window) signs agree."""
    if n <= window:
        return 1
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = agree ** math.log2(n / window)
    count = max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 2
    if count > MAX_PASSES:
        raise ValueError(f"{count} passes for {n} vectors: raise the window of {window}")
    return count


def _keys(passes: int, dim: int, seed: int):
    """One row per pass: (pass, key, id)."""
    def kernel(batches):
        planes = np.random.default_rng(seed).standard_normal((passes, dim, BITS))
        weights = (np.int64(1) << np.arange(BITS, dtype=np.int64))[::-1]
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for p in range(passes):
                keys = ((x @ planes[p] > 0) * weights).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array(keys, pa.int64()), batch.column(0)], ["pass", "sign", "vec_id"])
    return kernel


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches, keys: int):
    """(key, part of a batch) per run of rows with equal first ``keys`` columns."""
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        edges = np.flatnonzero(new) + 1
        for a, z in zip([0, *edges], [*edges, batch.num_rows]):
            if z > a:
                yield tuple(int(c[a]) for c in columns), batch.slice(a, z - a)


def _gathered(batches, keys: int):
    """(key, parts) per key of rows that arrive sorted by their first ``keys`` columns."""
    at, parts = None, []
    for key, part in _runs(batches, keys):
        if key != at:
            if parts:
                yield at, parts
            at, parts = key, []
        parts.append(part)
    if parts:
        yield at, parts


def _compare(dim: int, threshold: float):
    """Rows sorted by (pass, block), with ``own`` rows of the block and ``next`` ones: edges
    that span their links."""
    def links(parts):
        ids = np.concatenate([p.column(2).to_numpy() for p in parts])
        guest = np.concatenate([p.column(3).to_numpy(zero_copy_only=False).astype(bool) for p in parts])
        x = np.concatenate([_matrix(p.column(4), dim) for p in parts])
        order = np.lexsort((ids, guest))
        ids, x = ids[order], x[order]
        own = int((~guest).sum())
        groups = Groups(len(ids))
        close = x[:own] @ x.T >= threshold
        close &= np.arange(len(ids))[None, :] > np.arange(own)[:, None]
        left, right = np.nonzero(close)
        for a, b in zip(left.tolist(), right.tolist()):
            groups.union(a, b)
        roots = [(i, r) for i in range(len(ids)) if (r := groups.find(i)) != i]
        return ids[[i for i, _ in roots]], ids[[r for _, r in roots]], len(roots)

    def kernel(batches):
        for _, parts in _gathered(batches, 2):
            a, b, n = links(parts)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return kernel


def _within(dim: int, threshold: float):
    """Rows sorted by component, each of one tile at most: links of every member."""
    def kernel(batches):
        for _, parts in _gathered(batches, 1):
            ids = np.concatenate([p.column(1).to_numpy() for p in parts])
            held = np.concatenate([p.column(2).to_numpy() for p in parts])
            x = np.concatenate([_matrix(p.column(3), dim) for p in parts])
            close = x @ x.T >= threshold
            np.fill_diagonal(close, False)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(close @ held, pa.int64())], ["lead", "links"])
    return kernel


def _pack(dim: int):
    """Rows sorted by (component, tile): one row per tile, with the cap that holds it."""
    def kernel(batches):
        for (component, tile), parts in _gathered(batches, 2):
            ids = np.concatenate([p.column(2).to_numpy() for p in parts])
            held = np.concatenate([p.column(3).to_numpy() for p in parts])
            x = np.concatenate([_matrix(p.column(4), dim) for p in parts])
            centre = x.mean(axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-9 else x[0]
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            yield pa.RecordBatch.from_arrays(
                [pa.array([component], pa.int64()), pa.array([tile], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([held.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
                 pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius], pa.float64())],
                ["component", "tile", "leads", "held", "x", "centre", "radius"])
    return kernel


_PACKED = "component long, tile long, leads binary, held binary, x binary, centre array<double>, radius double"


def _across(dim: int, threshold: float):
    """Rows sorted by (component, tile), the tile itself before the others that it meets:
    links of every member of the tile."""
    def kernel(batches):
        at, ids, x, counts = None, None, None, None
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["lead", "links"])
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                held = np.frombuffer(batch.column(4)[k].as_buffer(), np.int64)
                other = np.frombuffer(batch.column(5)[k].as_buffer(), np.float64).reshape(-1, dim)
                if own := key != at:
                    if at is not None:
                        yield emit()
                    at, ids, x = key, np.frombuffer(batch.column(3)[k].as_py(), np.int64), other.copy()
                    counts = np.zeros(len(ids), np.int64)
                close = x @ other.T >= threshold
                if own:
                    np.fill_diagonal(close, False)
                counts += close @ held
        if at is not None:
            yield emit()
    return kernel


def count_links(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(lead, links) of ``members`` (component, lead, held, place, v): what all other members
    of the component within the threshold hold."""
    spark = members.sparkSession
    tile = max(1, TILE_BYTES // (8 * dim))
    narrow = members.select("component", "lead", "place")
    large = narrow.groupBy("component").count().where(F.col("count") > tile).select("component", F.lit(True).alias("large"))
    marked = cut_lineage(salted_join(narrow, large, ["component"]))
    spread = partitions(spark)
    small = marked.where("large is null").select("component", "lead").join(members.select("lead", "held", "v"), "lead").select(
        "component", "lead", "held", "v").repartition(spread, "component").sortWithinPartitions("component", "lead")
    out = cut_lineage(small.mapInArrow(_within(dim, threshold), "lead long, links long"))
    cut = marked.where("large")
    if cut.isEmpty():
        return out
    tiled = number_rows(cut, ["component"], ["place", "lead"], "rn", max_group_rows=TILE_ROWS).select(
        "component", F.floor((F.col("rn") - 1) / tile).alias("tile"), "lead")
    packed = cut_lineage(tiled.join(members.select("lead", "held", "v"), "lead").select(
        "component", "tile", "lead", "held", "v").repartition(spread, "component", "tile").sortWithinPartitions(
        "component", "tile", "lead").mapInArrow(_pack(dim), _PACKED))
    caps = packed.select("component", "tile", "centre", "radius")
    other = caps.select("component", F.col("tile").alias("other"), F.col("centre").alias("c"), F.col("radius").alias("r"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(
        F.zip_with("centre", "c", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p))))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    meet = caps.join(other, "component").where(
        (F.col("tile") == F.col("other")) | (apart <= F.col("radius") + F.col("r") + reach)).select("component", "tile", "other")
    dealt = meet.join(packed.select("component", F.col("tile").alias("other"), "leads", "held", "x"), ["component", "other"]).select(
        "component", "tile", (F.col("tile") != F.col("other")).alias("guest"), "leads", "held", "x")
    dealt = dealt.repartition(spread, "component", "tile").sortWithinPartitions("component", "tile", "guest")
    with batches_of(spark, 8):
        across = cut_lineage(dealt.mapInArrow(_across(dim, threshold), "lead long, links long"))
    return out.unionByName(across)


def _meet(classes: DataFrame, dim: int, threshold: float, window: int, passes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that ``passes`` passes bring together, and (lead, place) in the first one."""
    spark = classes.sparkSession
    keyed = classes.select(F.col("lead").alias("vec_id"), "v").mapInArrow(
        _keys(passes, dim, seed), "pass int, sign long, vec_id long")
    numbered = number_rows(keyed, ["pass"], ["sign", "vec_id"], "rn", max_group_rows=TILE_ROWS).withColumn(
        "block", F.floor((F.col("rn") - 1) / window).cast("int"))
    # The number of passes is the same small number for all rows.
    places = numbered.groupBy("vec_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pass", "block"))), lambda s: s["block"]).alias("blocks"))
    placed = classes.select(F.col("lead").alias("vec_id"), "v").join(places, "vec_id")
    each = placed.select(F.posexplode("blocks").alias("pass", "own"), "vec_id", "v")
    dealt = each.withColumn("block", F.explode(F.array("own", F.col("own") - 1))).where("block >= 0").select(
        "pass", "block", "vec_id", (F.col("block") != F.col("own")).alias("guest"), "v")
    dealt = dealt.repartition(partitions(spark), "pass", "block").sortWithinPartitions("pass", "block")
    with batches_of(spark, 2000):
        found = cut_lineage(dealt.mapInArrow(_compare(dim, threshold), "a long, b long"))
    return found, numbered.where("pass = 0").select(F.col("vec_id").alias("lead"), F.col("rn").alias("place"))


def _joined(linked: DataFrame) -> int:
    """How many nodes have been joined to another that leads them."""
    return linked.where("node <> component").count()


def _extend(linked: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """Components (node, component) with the edges ``found`` added, and how many they join."""
    of = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    edges = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
    edges = cut_lineage(edges)
    if edges.isEmpty():
        return linked, 0
    moved = cut_lineage(components(edges))
    fresh = moved.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    both = salted_join(linked.unionByName(fresh), to, ["component"], salt_by=["node"])
    return cut_lineage(both.select("node", F.coalesce("to", "component").alias("component"))), _joined(moved)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, window: int = WINDOW, recall: float = 0.98, seed: int = 20,
    key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """(key, n_links, component_id, kept) per row of ``vectors``.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest key
    reachable by links, and ``kept`` marks the row that leads its component.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(
        "vec_id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    squared = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    usable = F.coalesce(F.col("v").isNotNull() & finite & (squared > 0) & (squared < F.lit(float("inf"))), F.lit(False))
    common = rows.where(usable).groupBy(F.size("v").alias("dim")).count().agg(
        F.max_by("dim", F.struct("count", "dim"))).first()[0]
    if common is None:
        return rows.select(F.col("vec_id").alias(key), F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    valid = rows.where(usable & (F.size("v") == common))
    lead = valid.groupBy("v").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("held"))
    classes = cut_lineage(lead)
    n = classes.count()
    passes = passes_for(n, threshold, window, recall)
    found, first = _meet(classes, common, threshold, window, passes, seed)
    linked = cut_lineage(components(found))
    joined, more = _joined(linked), n > window
    while more:
        found, _ = _meet(classes, common, threshold, window, passes, seed + passes)
        linked, new = _extend(linked, found)
        passes, joined = 2 * passes, joined + new
        more = new > (1 - recall) * joined
    linked = linked.select(F.col("node").alias("lead"), "component")
    counts = count_links(linked.join(first, "lead").join(classes, "lead"), common, threshold)
    per_class = classes.join(counts, "lead", "left").join(linked, "lead", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"), F.coalesce("component", "lead").alias("component"))
    of_row = valid.select("vec_id", "v").join(per_class, "v").select("vec_id", "n_links", "component")
    others = rows.where(~(usable & (F.size("v") == common))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return of_row.unionByName(others).select(
        F.col("vec_id").alias(key), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"),
        (F.col("vec_id") == F.col("component")).alias("kept"))
