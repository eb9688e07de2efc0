"""Learned scores: held-out accuracy, and defined results for odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    got = queries.QUERIES[name](spark, SF).toPandas().merge(
        spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    return got[got.held_out & got[label].notna()]


def test_quality_held_out(spark):
    got = held_out(spark, "op5_quality_scores", "quality")
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    got = held_out(spark, "op6_toxicity_scores", "toxic")
    clean = got[got.toxic == 0]
    assert (clean.predicted == 1).mean() < 0.05 and got[got.toxic == 1].predicted.mean() > 0.6
    assert got.score.between(0, 1).all() and got.evidence.map(len).max() == 3


def test_toxicity_like_all_cosines(spark):
    """The whole query against a recount: words chosen, frequencies, every cosine, votes."""
    docs = [(i, t or "") for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = {i: y for i, y in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect() if y in (0, 1)}
    bags = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t in docs}
    train = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5 and i in bags)
    y = np.array([labels[i] for i in train], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    hold = {1: Counter(), 0: Counter()}
    for i in train:
        hold[labels[i]].update(set(bags[i]))
    often = [w for w in hold[0] | hold[1] if hold[0][w] + hold[1][w] >= 3]

    def surprise(a, b):
        table = [[a, n1 - a], [b, n0 - b]]
        whole, got = n1 + n0, 0.0
        for row in table:
            for j, cell in enumerate(row):
                if cell:
                    got += 2 * cell * np.log(cell * whole / (sum(row) * (table[0][j] + table[1][j])))
        return got
    bar = 2 * np.log(len(often)) + 8
    terms = sorted(w for w in often if hold[1][w] * n0 > hold[0][w] * n1 and surprise(hold[1][w], hold[0][w]) > bar)
    assert terms
    idf = {w: np.log((1 + len(docs)) / (1 + sum(w in b for b in bags.values()))) + 1 for w in terms}

    def vector(i):
        v = np.array([(1 + np.log(bags[i][w])) * idf[w] if w in bags[i] else 0.0 for w in terms])
        return v / (np.linalg.norm(v) or 1)
    known = np.array([vector(i) for i in train])
    spoken = known.any(axis=1)
    share = (n1 + 1) / (n1 + n0 + 2)
    silent = (y[~spoken].sum() + share) / ((~spoken).sum() + 1)
    ids = np.array(train)[spoken]
    want = {}
    for i, _ in docs:
        cosine = known[spoken] @ vector(i)
        best = [k for k in np.lexsort((ids, -np.round(cosine, 12))) if cosine[k] > 0][:toxicity.NEIGHBOURS]
        w = cosine[best] ** 2
        want[i] = (w @ y[spoken][best] + 0.25 * share) / (w.sum() + 0.25) if best else silent
    got = {r.doc_id: r.score for r in queries.QUERIES["op6_toxicity_scores"](spark, SF).select("doc_id", "score").collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = queries.QUERIES["op9_language_id"](spark, SF).toPandas().merge(docs, on="doc_id")
    got = got[got.held_out]
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98


def test_odd_rows(spark, messy, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)] + [(99, 7, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(messy, labels, "quality", F.lit(True))
    scored = quality.score(messy, model)
    assert scored.count() == messy.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, quality.train(none, labels, "quality", F.lit(True))).count() == 0
    index = toxicity.train(messy, labels, "toxic", F.lit(True))
    assert toxicity.score(messy, index).where("score is null").count() == 0
    assert toxicity.score(none, toxicity.train(none, labels.where("1 = 0"), "toxic", F.lit(True))).count() == 0
    profiles = language.train(messy, F.lit(True))
    got = {r.doc_id: r for r in language.identify(messy, profiles).collect()}
    assert profiles.names == ["en"] and [got[i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4 and got[6].lang_pred == "en"
    assert language.identify(messy, language.train(none, F.lit(True))).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_boosted_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=3000) < 0.02)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_nearest_examples_are_exact():
    """Block-max search against all cosines."""
    rng = np.random.default_rng(2)
    n, terms = 700, 40
    index = toxicity.Examples(0.5, 0.5, {f"t{i}": i for i in range(terms)}, rng.uniform(1, 5, terms), np.arange(n) * 3, rng.integers(0, 2, n).astype(float))
    vectors = [tuple(sorted((int(t), int(c)) for t, c in zip(rng.choice(terms, k, replace=False), rng.integers(1, 4, k)))) for k in rng.integers(1, 6, n)]
    places, weights = [[] for _ in range(terms)], [[] for _ in range(terms)]
    dense = np.zeros((n, terms))
    for place, v in enumerate(vectors):
        for (t, _), w in zip(v, index.weigh(v)):
            places[t].append(place)
            weights[t].append(w)
            dense[place, t] = w
    index.places, index.weights = [np.array(p) for p in places], [np.array(w) for w in weights]
    blocks = -(-n // toxicity.BLOCK)
    index.starts = np.stack([np.searchsorted(p, np.arange(blocks + 1) * toxicity.BLOCK) for p in index.places])
    index.block_max = np.zeros((terms, blocks))
    for t in range(terms):
        np.maximum.at(index.block_max[t], index.places[t] // toxicity.BLOCK, index.weights[t])
    for v in vectors[:60]:
        q = np.zeros(terms)
        q[[t for t, _ in v]] = index.weigh(v)
        want = np.sort(dense @ q)[::-1][:15]
        assert index.nearest(v)[1] == pytest.approx(want[want > 1e-12], abs=1e-9)
