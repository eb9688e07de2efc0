"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

All words that go with the label (a likelihood ratio above what chance gives over the whole
vocabulary of the examples) span the space, however many; over the whole vocabulary the
cosine follows topic and length, and finds less than half as many.  Their document frequencies are counted over all documents.
Labelled examples, at most ``max_rows`` of them, form a block-max inverted index: per term
the postings, cut in blocks of examples, and the largest weight of each block.  A query
visits blocks by their bound and stops when the bound falls below its k-th best cosine, so
the neighbours are exact.  Their votes, weighted by closeness, give the score, and the
nearest examples are its evidence.

Texts without any of the words get the smoothed label share of examples without them; null
texts count as empty.  Ties in cosine go to the smaller example id.  Repeated rows repeat.
Without labels of both kinds every score is the smoothed share of 1.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import bound_text_batches, labelled_sample

MAX_ROWS = 8_000
BLOCK = 64
NEIGHBOURS = 15
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall((text or "").lower())


def _word_counts(batches):
    """Per task: (word, texts labelled 1, texts labelled 0); the word null counts texts."""
    for batch in batches:
        hit: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hit[label].update({None, *words(text)})
        seen = list(hit[0] | hit[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.string()), pa.array([hit[1][w] for w in seen], pa.int64()), pa.array([hit[0][w] for w in seen], pa.int64())],
            ["word", "ones", "zeros"])


def _term_counts(terms: frozenset[str]):
    """Per task: texts that hold each term; the term null counts all texts."""
    def kernel(batches):
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(terms.intersection(words(text)))
                count[None] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "texts"])
    return kernel


@dataclass
class Examples:
    """Block-max inverted index over labelled examples."""

    share: float
    silent: float = 0.0
    terms: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.empty(0))
    places: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    starts: np.ndarray = field(default_factory=lambda: np.empty((0, 1), np.int64))
    block_max: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def vector(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(term, count) of a text, in the order of terms."""
        count = Counter(t for w in words(text) if (t := self.terms.get(w)) is not None)
        return tuple(sorted(count.items()))

    def weigh(self, vector: tuple[tuple[int, int], ...]) -> np.ndarray:
        w = np.array([(1 + np.log(c)) * self.idf[t] for t, c in vector])
        return w / np.linalg.norm(w)

    def nearest(self, vector: tuple[tuple[int, int], ...], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above zero."""
        q = self.weigh(vector)
        terms = [t for t, _ in vector]
        bound = q @ self.block_max[terms]
        best_at, best = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms, q):
                a, z = self.starts[t, b], self.starts[t, b + 1]
                score[self.places[t][a:z] - b * BLOCK] += w * self.weights[t][a:z]
            hit = np.flatnonzero(score > 0)
            at, score = np.concatenate((best_at, hit + b * BLOCK)), np.concatenate((best, score[hit]))
            order = np.lexsort((self.ids[at], -np.round(score, 12)))[:k]
            best_at, best = at[order], score[order]
        return best_at, best

    def vote(self, vector: tuple[tuple[int, int], ...]) -> tuple[float, list[int]]:
        """Score and evidence: votes weighted by the square of the cosine, and one more vote
        of the general share."""
        if not vector:
            return self.silent, []
        at, cosine = self.nearest(vector)
        w = cosine**2
        rest = 0.25
        return float((w @ self.labels[at] + rest * self.share) / (w.sum() + rest)), self.ids[at[:3]].tolist()


def _example_rows(terms: dict[str, int]):
    index = Examples(0.0, terms=terms)

    def kernel(batches):
        for batch in batches:
            found = [index.vector(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[t for t, _ in v] for v in found], pa.list_(pa.int32())),
                 pa.array([[c for _, c in v] for v in found], pa.list_(pa.int32()))], ["_id", "label", "terms", "counts"])
    return kernel


def _ratio(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood ratio of a word's counts against no association."""
    total = 0.0
    for got, n in ((ones, n1), (zeros, n0)):
        expected = (ones + zeros) * n / (n1 + n0)
        other, other_expected = n - got, n - expected
        for a, e in ((got, expected), (other, other_expected)):
            total = total + 2 * np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(e, 1e-9)), 0)
    return total


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int = MAX_ROWS,
          key: str = "doc_id", text: str = "text") -> Examples:
    """Build the index of labelled rows for which ``usable``, a condition on the key, holds."""
    bound_text_batches(docs.sparkSession)
    sample = labelled_sample(labels, docs, label, usable, max_rows, key, text)
    counts = sample.select("label", "text").mapInArrow(_word_counts, "word string, ones long, zeros long").groupBy("word").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    # A word of the bounded sample that fewer than three texts hold says nothing.
    counts = counts.where("word is null or ones + zeros >= 3").toPandas()
    general = counts[counts["word"].isna()]
    n1, n0 = (float(general[c].sum()) for c in ("ones", "zeros"))
    share = (n1 + 1) / (n1 + n0 + 2)
    counts = counts[counts["word"].notna()].copy()
    if min(n1, n0) == 0 or not len(counts):
        return Examples(share, share)
    counts["ratio"] = _ratio(counts["ones"].to_numpy(float), counts["zeros"].to_numpy(float), n1, n0)
    # What chance reaches over so many words, with a margin.
    counts = counts[(counts["ratio"] > 2 * np.log(len(counts)) + 8) & (counts["ones"] * n0 > counts["zeros"] * n1)]
    terms = {w: i for i, w in enumerate(sorted(counts["word"]))}
    if not terms:
        return Examples(share, share)
    held = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
        _term_counts(frozenset(terms)), "word string, texts long").groupBy("word").agg(F.sum("texts").alias("texts")).collect()
    texts = {r["word"]: r["texts"] for r in held}
    idf = np.array([np.log((1 + texts[None]) / (1 + texts.get(w, 0))) + 1 for w in terms])
    rows = sample.mapInArrow(_example_rows(terms), "_id long, label int, terms array<int>, counts array<int>").toPandas()
    spoken = rows["terms"].map(len) > 0
    quiet = rows[~spoken]
    silent = (quiet["label"].sum() + share) / (len(quiet) + 1)
    rows = rows[spoken]
    # Alike examples lie in one block, so that block bounds are tight.
    vectors = [tuple(zip(map(int, t), map(int, c))) for t, c in zip(rows["terms"], rows["counts"])]
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i], rows["_id"].iloc[i]))
    index = Examples(share, float(silent), terms, idf, rows["_id"].to_numpy(np.int64)[order], rows["label"].to_numpy(float)[order])
    blocks = max(1, -(-len(order) // BLOCK))
    places: list[list[int]] = [[] for _ in terms]
    weights: list[list[float]] = [[] for _ in terms]
    for place, i in enumerate(order):
        for (t, _), w in zip(vectors[i], index.weigh(vectors[i])):
            places[t].append(place)
            weights[t].append(w)
    index.places = [np.array(p, np.int64) for p in places]
    index.weights = [np.array(w) for w in weights]
    index.starts = np.stack([np.searchsorted(p, np.arange(blocks + 1) * BLOCK) for p in index.places])
    index.block_max = np.zeros((len(terms), blocks))
    for t, (p, w) in enumerate(zip(index.places, index.weights)):
        np.maximum.at(index.block_max[t], p // BLOCK, w)
    return index


def _scores(index: Examples):
    def kernel(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                v = index.vector(text)
                if v not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[v] = index.vote(v)
                out.append(known[v])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))],
                ["key", "score", "evidence"])
    return kernel


def score(docs: DataFrame, index: Examples, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, evidence) per row; ``evidence`` holds the ids of the nearest examples."""
    bound_text_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_scores(index), "key long, score double, evidence array<long>").withColumnRenamed("key", key)
