"""Planted items are found, clean documents stay."""

import random
from itertools import combinations

import numpy as np
import pytest

from framewright.llm import decontamination as D


def tables(spark, sf):
    return (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))


def test_given_documents(spark):
    docs, benchmark = tables(spark, "/root/testdata/sf0.01")
    items = {r.item_id: b" ".join(D.tokens(r.text)) for r in benchmark.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items()
            if b" " + t + b" " in b" " + b" ".join(D.tokens(r.text)) + b" "}
    got = D.find_leaks(docs, benchmark)
    assert len(want) > 10 and {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert D.drop_leaks(docs, benchmark).count() == docs.count() - len({d for d, _ in want})


def test_paraphrase_long_text_and_messy_rows(spark, messy, none):
    _, benchmark = tables(spark, "/root/testdata/sf0.001")
    item = max(benchmark.collect(), key=lambda r: len(r.text))
    words = item.text.split()
    rng = random.Random(1)
    changed = [w if rng.random() > 0.12 else f"zz{k}" for k, w in enumerate(words)]
    changed[-6:] = words[-6:]
    filler = " ".join(f"q{rng.randrange(10**6)}" for _ in range(9000))
    rows = [(1000, " ".join(changed)), (1001, filler + " " + item.text.upper() + " " + filler), (1002, " ".join(rng.sample(words, len(words)))),
            (1003, " ".join(words[:len(words) // 3]))]
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    odd = benchmark.unionByName(spark.createDataFrame([(900, None), (901, ""), (None, "no id"), (902, "x")], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, odd).collect()}
    assert {(1000, item.item_id), (1001, item.item_id)} <= got
    assert not {d for d, i in got if i != 902} & {1002, 1003}
    assert D.drop_leaks(messy, benchmark).count() == messy.count()
    assert D.find_leaks(none, benchmark).count() == 0 and D.find_leaks(docs, benchmark.where("1 = 0")).count() == 0


def test_slices_hold_all_items(spark):
    _, benchmark = tables(spark, "/root/testdata/sf0.001")
    cut = list(D.slices(benchmark, slice_words=100))
    assert len(cut) > 1 and sorted(i for s in cut for i, _ in s) == sorted(r.item_id for r in benchmark.collect())


def test_common_subsequence():
    def plain(a, b):
        best = 0
        for n in range(len(a), 0, -1):
            for pick in combinations(range(len(a)), n):
                it = iter(b)
                if all(a[k] in it for k in pick):
                    return n
        return best
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        assert D.common_subsequence(a, b) == plain(a, b)


def test_spread_paraphrases_and_short_copies_in_rare_words(spark):
    """All words of an item in order, other words between them, inside prose of words that no other document has."""
    _, benchmark = tables(spark, "/root/testdata/sf0.01")
    items = [(r.item_id, r.text.split()) for r in benchmark.collect() if len(r.text.split()) >= 12]
    rng, rows, want = random.Random(6), [], {}

    def rare(n):
        return [f"q{rng.randrange(10**9)}x" for _ in range(n)]
    for spread in (1.0, 1.25, 1.7):
        for item, words in items:
            gaps = sorted(rng.randrange(1, len(words)) for _ in range(int((spread - 1) * len(words))))
            text = [w for i, own in enumerate(words) for w in rare(gaps.count(i)) + [own]]
            want.setdefault(spread, set()).add((len(rows), item))
            rows.append((len(rows), " ".join(rare(60) + text + rare(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, benchmark).collect()}
    share = {k: len(got & w) / len(w) for k, w in want.items()}
    assert share[1.0] == 1.0 and min(share.values()) >= 0.95, share


@pytest.mark.parametrize("seed", [1, 2])
def test_the_space_is_that_of_all_documents(spark, seed):
    """Axes against a plain decomposition of the rows of all passages and of every document."""
    rng, rank = random.Random(seed), 40
    vocab = [f"w{k}" for k in range(50)]  # the basis is as wide as that, so nothing is left to chance
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(4)]
    texts = [" ".join(rng.choices([*vocab[k % 30:], "other"], k=rng.randrange(80))) for k in range(700)]
    words = D.vocabulary_of(items)
    n = len(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(5)
    numbered = docs.mapInArrow(D._number_rows(words), "key long, numbers binary")
    space = D.latent_space(numbered, items, words, rank)
    held = [[words[w] for w in D.tokens(t) if w in words] for t in texts]
    idf = np.log((len(texts) + 1) / (np.bincount([w for h in held for w in set(h)], minlength=n) + 1)) + 0.1

    def square(rows):
        a = np.array([np.bincount(r, minlength=n) * idf for r in rows if len(r)])
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        return a.T @ a
    own = [r for _, t in items for r in D._passage_rows(np.array([words[w] for w in D.tokens(t)]), n)]
    values, axes = np.linalg.eigh(square(own) + D.DOCS_SHARE * len(own) / len(texts) * square(held))
    best = axes[:, np.argsort(-values)[:rank]]
    got = space.axes[:n] / idf[:, None]
    assert np.abs(got @ got.T - best @ best.T).max() < 1e-3


def test_sums_of_the_space_do_not_grow_with_the_partitions(spark, monkeypatch):
    """A task that adds up sends as much as the vocabulary is large, so a core sends one."""
    sent, through = spark.sparkContext.accumulator(0), D._through

    def counted(*given):
        inner = through(*given)

        def kernel(batches):
            sent.add(1)
            yield from inner(batches)
        return kernel
    monkeypatch.setattr(D, "_through", counted)
    items = [(0, " ".join(f"w{k}" for k in range(40)))]
    words = D.vocabulary_of(items)
    docs = spark.range(400).selectExpr("id as key", "concat('w', id % 40, ' w', id % 7) as text").repartition(50)
    D.latent_space(docs.mapInArrow(D._number_rows(words), "key long, numbers binary"), items, words, 10)
    assert 0 < sent.value <= 3 * spark.sparkContext.defaultParallelism


def test_jobs_do_not_grow_with_the_partitions(spark, monkeypatch):
    """Sums and items come to the driver in one job or page, not in one job per shuffle partition."""
    monkeypatch.setattr(D, "PAGE_ITEMS", 8, raising=False)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    items = [(i, f"text{t} " + " ".join(f"w{(i * 7 + k) % 90}" for k in range(40))) for i in range(12) for t in range(1 + i % 2)]
    benchmark = spark.createDataFrame([*items, items[0], (None, "no id"), (99, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"a b {items[k][1]} c") for k in range(5)] + [(9, "a b c")], "doc_id long, text string")
    jobs = []
    try:
        for n in (5, 60):
            for k, v in zip(held, (str(n), "false")):
                spark.conf.set(k, v)
            spark.sparkContext.setJobGroup(f"leaks-{n}", "")
            assert [r for s in D.slices(benchmark) for r in s] == sorted(items)
            got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, benchmark).collect()}
            assert {(k, items[k][0]) for k in range(5)} <= got and 9 not in {d for d, _ in got}
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"leaks-{n}")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert 0 < jobs[1] <= jobs[0] + 3, jobs
