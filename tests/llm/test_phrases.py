"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from framewright.llm import phrases


def plain(rows, threshold, top):
    f, total = {}, Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    f.setdefault(lang or "und", Counter())[tuple(words[i:i + n])] += 1
    out = []
    for lang, counts in f.items():
        many = {p: c for p, c in counts.items() if 2 <= len(p) and c >= threshold}
        n, scored = total[lang], []
        for p, a in many.items():
            if any(len(q) > len(p) and many[q] >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in many):
                continue
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, n, -s))
    return sorted(out)


def corpus(seed, texts=120):
    rng = random.Random(seed)
    words = ["New", "york", "the", "a", "A", "of", "city", "é", "日本", "x-y", "\x1f", "it's", "(b)"]
    fixed = ["New York City", "the end of the", "a a a a a a", "of the X-Y of the", "日本 é"]
    out = []
    for _ in range(texts):
        parts = [rng.choice(fixed) if rng.random() < .4 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for p in parts)))
    return out + [("fr", None), ("fr", ""), ("it", " . \n"), ("it", "one")]


@pytest.mark.parametrize("seed, small", [(1, False), (2, True)])
def test_as_plain_counting(spark, monkeypatch, seed, small):
    if small:  # many blocks, many hash partitions
        monkeypatch.setattr(phrases, "BLOCK_BYTES", 2_000)
        monkeypatch.setattr(phrases, "PARTITION_PHRASES", 500)
        monkeypatch.setattr(phrases, "HELD_PHRASES", 20)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, phrase int, block string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, threshold=8, top=30).collect())
    assert got == plain(rows, 8, 30)
    assert len(got) > 60


def test_other_column_names_and_repeats(spark):
    rows = [("en", "big red dog")] * 12
    docs = spark.createDataFrame(rows, "lang string, body string").withColumnRenamed("lang", "tongue")
    got = [tuple(r) for r in phrases.collocations(docs, threshold=10, text="body", lang="tongue").collect()]
    assert got == [("en", 1, "big red dog", 12, 12, 12, 36, 3000)]


def test_nothing_frequent_and_empty(spark, messy, none):
    assert phrases.collocations(none).count() == 0
    got = [r.phrase for r in phrases.collocations(messy, threshold=1000).collect()]
    assert sorted(got) == [" ".join(["word"] * n) for n in (2, 3, 4, 5)]  # each longer one comes once less


def test_no_frequent_hash_is_lost():
    rng = np.random.default_rng(5)
    for trial in range(20):
        pieces = []
        for _ in range(40):
            keys = np.unique(np.concatenate((rng.integers(0, 1 << 32, 3000), rng.integers(0, 60, 40))).astype(np.uint32))
            pieces.append((keys, np.where(keys < 60, rng.integers(1, 9, len(keys)), 1).astype(np.int64)))
        truth = Counter()
        for k, c in pieces:
            for a, b in zip(k.tolist(), c.tolist()):
                truth[a] += b
        many = {k for k, c in truth.items() if c >= 100}
        for slack in (1, 4):
            left = phrases.summarise([phrases._pack(*p) for p in pieces], 100, slack)
            assert many <= set(left.tolist()) and (np.diff(left.astype(np.int64)) > 0).all()
            assert len(left) <= slack * sum(truth.values()) // 100 + 1


def test_summary_bound_is_checked():
    summary = phrases.Summary(2)
    for k in range(50):
        summary.merge(np.array([k, 1000], np.uint32), np.array([3, 1]))
    assert summary.lost and len(summary.keys) <= 2
    short = 50 - dict(zip(summary.keys.tolist(), summary.counts.tolist())).get(1000, 0)
    assert 0 <= short <= summary.lost <= 200 // 3


def test_counts_past_64_bits(spark, monkeypatch):
    from pyspark.sql import functions as F

    def huge(docs, *_):
        big = spark.createDataFrame([("en", 1, "a", 10 ** 13), ("en", 1, "b", 10 ** 13 - 7), ("en", 2, "a b", 10 ** 13 - 9)], "lang string, size int, phrase string, f long")
        return big, spark.range(1).select(F.lit("en").alias("lang"), F.lit(10 ** 15).cast("long").alias("n"))
    monkeypatch.setattr(phrases, "frequent_phrases", huge)
    r = phrases.collocations(None).first()
    assert r.score == 1000 * (10 ** 13 - 9) * 10 ** 15 // (10 ** 13 * (10 ** 13 - 7))
