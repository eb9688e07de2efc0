"""Runs against a walk over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import queries, runs


def plain(words, min_length=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, 3 * q):
                found.setdefault((i, j + q), q)  # periods ascend: the smallest one stays
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def plant(words, key):
    h = zlib.crc32(key.encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def row_of(words):
    found = [(s, e - s, q) for s, e, q in plain(words)]
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *best, best[2] and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts(rng):
    out = [[], [0], [0] * 23, [0] * 24, [0, 1] * 12, [0] * 700, [0, 1] * 300, list(range(300)), [0, 1, 2] * 8 + [0] * 30]
    for _ in range(60):
        t = []
        for _ in range(rng.randint(1, 6)):
            block = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
            t += (block * rng.randint(1, 12))[:rng.randint(1, 300)]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_texts_together(seed):
    group = texts(random.Random(seed))
    got = runs.find_runs([np.array(t, np.int64) for t in group])
    for t, rows in zip(group, got):
        assert [tuple(r) for r in rows.tolist()] == plain(t)


def test_small_pieces_of_the_grid_change_nothing(monkeypatch):
    group = texts(random.Random(9))
    monkeypatch.setattr(runs, "GRID_PLACES", 50)
    got = runs.find_runs([np.array(t, np.int64) for t in group])
    assert [[tuple(r) for r in rows.tolist()] for rows in got] == [plain(t) for t in group]


def test_extensions_word_by_word():
    rng = random.Random(3)
    x = np.array([rng.randrange(2) for _ in range(400)] * 3 + [7])
    lce = runs.CoverLce(x)
    i = np.array([rng.randrange(1199) for _ in range(4000)])
    j = np.minimum(i + np.array([rng.randrange(1, 900) for _ in range(4000)]), 1200)
    i, j = i[i < j], j[i < j]
    for a, b, n in zip(i.tolist(), j.tolist(), lce(i, j).tolist()):
        m = 0
        while x[a + m] == x[b + m]:
            m += 1
        assert m == n


def test_ties_take_the_first_start():
    assert runs.greatest([(0, 24, 2), (30, 36, 3), (70, 24, 2)]) == (0, 24, 2)
    assert runs.greatest([(0, 25, 2), (30, 38, 3)]) == (30, 38, 3) and runs.greatest([]) is None


def test_long_texts_are_not_quadratic():
    for t in (np.zeros(200_000, np.int64), np.arange(200_000) % 1000, np.arange(200_000)):
        found = runs.find_runs([t])[0].tolist()
        assert found == ([] if t[-1] == 199_999 else [[0, 200_000, 1 if t.max() == 0 else 1000]])


def test_whole_query_against_the_walk(spark, sf):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        words = plant((docs[r.doc_id] or "").encode().split(), str(r.doc_id))
        if len(words) <= 3000:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == row_of(words), r.doc_id
    assert sum(r.n_runs > 0 for r in got) >= 10


def test_planted_words(spark):
    words = [b"w%d" % (i % 97) for i in range(500)]
    rows = [(i, " \t" + " \n".join(w.decode() for w in words[:i])) for i in range(0, 500, 7)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text or "").encode().split() for r in runs.planted(docs).collect()}
    assert got == {k: plant((t or "").encode().split(), str(k)) for k, t in rows}
    assert sum(got[k] != (t or "").encode().split() for k, t in rows) >= 2


def test_messy_rows(messy, none):
    rows = runs.periodic_runs(messy).collect()
    assert len(rows) == messy.count()
    got = {r.doc_id: r for r in rows if r.doc_id != 3}
    assert [(r.start, r.length, r.period) for r in got[9].runs] == [(0, 30_000, 1)] and got[9].collapsed == "word"
    assert got[0].runs == [] and got[0].best is None and got[0].collapsed == got[2].collapsed == ""
    assert got[None].n_words == 2 and [r.collapsed for r in rows if r.doc_id == 3].count("one two") == 2
    assert runs.periodic_runs(none).count() == 0 and runs.planted(none).count() == 0
    assert runs.planted(messy).columns == messy.columns
    assert messy.where(F.col("doc_id").isNull()).count() == runs.planted(messy).where(F.col("doc_id").isNull()).count()
