"""Components against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from framewright.llm import jaccard
from framewright.llm.common import components


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    k = min(n, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, n, percent):
    sets = defaultdict(set)
    for d, t in rows:
        if d is not None and len(shingle_set(t, n)) >= len(sets[d]):
            sets[d] = shingle_set(t, n)
    lead = {d: d for d in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            lead[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def as_dict(out):
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_given_documents(spark, sf, n, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert as_dict(jaccard.jaccard_classes(docs, n, percent)) == brute(docs.collect(), n, percent)


def test_large_group_of_near_copies_in_blocks(spark):
    """A chain of edits, many copies, and a passage that all share, cut in blocks of eight."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(60)]
    rows, text = [], list(base)
    for i in range(60):
        text = list(text)
        text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    rows += [(200 + i, " ".join(base[:30] + [rng.choice(words) for _ in range(40)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_dict(jaccard.jaccard_classes(docs, 3, 85, block_rows=8)) == brute(rows, 3, 85)


def test_messy_rows(messy, none):
    got = as_dict(jaccard.jaccard_classes(messy, 4, 85))
    assert got == brute([(r.doc_id, r.text) for r in messy.collect()], 4, 85)
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[4] == (1, 3) and got[13][1] == 12
    kept = jaccard.keep_one(messy, 4, 85)
    assert set(kept.columns) == set(messy.columns)
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 13").count() == 0
    assert jaccard.jaccard_classes(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_divide_skip_finds_exactly_the_links():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(40, rng.integers(8, 30), replace=False)).astype(np.int64) for _ in range(60)]
    sizes = [len(s) for s in sets]
    groups = jaccard.divide_skip(sizes, sets, list(range(60)), list(range(60)), 60)
    lead = jaccard.Groups(60)
    for a, b in combinations(range(60), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 60 * (sizes[a] + sizes[b] - both):
            lead.union(a, b)
    assert [groups.find(i) for i in range(60)] == [lead.find(i) for i in range(60)]


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_have_as_many_tasks_as_their_edges_need(spark, monkeypatch):
    """Whatever the session's number of shuffle partitions: each task of a round leaves files."""
    from framewright.llm import common
    tasks, cut, keys = [], common.cut_lineage, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]

    def noted(df):
        out = cut(df)
        tasks.append(out.rdd.getNumPartitions())
        return out
    monkeypatch.setattr(common, "cut_lineage", noted)
    edges = spark.range(4_000).selectExpr("id as a", "id + 1 - id % 7 as b")
    want = dict(components(edges).collect())
    for k, v in zip(keys, ("64", "false")):
        spark.conf.set(k, v)
    try:
        tasks.clear()
        assert dict(components(edges).collect()) == want and max(tasks[1:]) == 1, tasks
        tasks.clear()
        monkeypatch.setattr(common, "TASK_EDGES", 500)
        assert dict(components(edges).collect()) == want and 1 < max(tasks[1:]) <= 8, tasks
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
