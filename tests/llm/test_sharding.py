"""Balance, whole groups and gapless slots."""

import zlib

import numpy as np

from framewright.llm import sharding


def check(out, docs, shards):
    got = out.toPandas()
    assert len(got) == docs.count()
    assert got.shard.between(0, shards - 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    return got


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(sharding.balance(docs, 8, bucket_groups=30), docs, 8)
    got = check(sharding.balance(docs, 8, piece_rows=2), docs, 8).merge(docs.toPandas(), on="doc_id")
    assert (got["size"] == [len(t.encode()) + 16 for t in got.text]).all() and (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all()
    assert (got.groupby("text").shard.nunique() == 1).all()
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() <= max(loads.mean() * 1.02, got.groupby("text")["size"].sum().max())


def test_hot_group_and_messy_rows(spark, messy, none):
    docs = messy.select("doc_id", "text").unionByName(spark.range(1000, 1400).selectExpr("id as doc_id", "'a hot text' as text"))
    got = check(sharding.balance(docs, 5, piece_rows=7), docs, 5)
    assert got[got.doc_id >= 1000].shard.nunique() == 1
    empty = got[got["size"] == 16]
    assert len(empty) == 2 and (empty.text_crc32 == 0).all() and empty.shard.nunique() == 1
    assert sharding.balance(none, 5).count() == 0


def test_a_tree_of_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3).crossJoin(spark.range(40)).selectExpr("doc_id * 1000 + id + 90000 as doc_id", *[c for c in docs.columns if c != "doc_id"]))
    got = check(sharding.balance(docs, 8, bucket_groups=4, piece_rows=3, fan=3), docs, 8).merge(docs.toPandas(), on="doc_id")
    assert (got.groupby("text").shard.nunique() == 1).all()
    loads = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    # What differencing guarantees with a few groups a bucket: shards differ by one group at most.
    assert loads.max() - loads.min() <= got.groupby("text")["size"].sum().max()


def test_differencing_places_every_part_once():
    rng = np.random.default_rng(3)
    sizes = rng.pareto(1.5, 400) * 100
    partials = []
    for k, s in enumerate(sizes):
        sums = np.zeros(7)
        sums[0] = s
        partials.append((sums, k))
    places = sharding.difference(partials, 7)
    assert all(sorted(where) == list(range(7)) for _, where in places)
    loads = np.zeros(7)
    for k, where in places:
        loads[where[0]] += sizes[k]
    greedy = np.zeros(7)
    for s in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += s
    assert loads.max() - loads.min() <= greedy.max() - greedy.min() + 1e-9
    assert sharding.difference([(np.zeros(7), "one")], 7)[0][1].tolist() == list(range(7))
