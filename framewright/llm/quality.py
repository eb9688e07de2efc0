"""Quality by a generalised additive model with pairwise interactions.

Every text becomes a few shape features (lengths, shares of character classes, repeats).
Each feature is cut in bins, and a lookup table per feature is learnt by cyclic boosting:
in turn, a tree of at most four leaves over the feature's bins is fitted to the gradient and
added to its table.  Then the pairs with the largest remaining gain get tables of their own,
boosted by trees of one cut per side.  A score is the sigmoid of the bins' sum.

Learning takes at most ``max_rows`` labelled rows, those with the smallest hash of their id;
their features (a few numbers a row) are what the driver sees.  Scoring reads each text once.

Null texts count as empty and are scored.  Repeated rows repeat; a label that is neither 0
nor 1 is not used; without labels of both kinds every score is the smoothed share of 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import bound_text_batches, labelled_sample

MAX_ROWS = 20_000

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "pipes", "exclaims", "non_ascii",
    "distinct_words", "repeated_lines", "log_line_length", "words_per_stop", "symbol_tail", "short_words", "top_word",
)

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = (1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 0 if _c in (9, 10, 11, 12, 13, 32)
                  else 5 if _c >= 128 else 4)
_TAILS = frozenset(b"!#$%&*|~^=<>@_")


def features(text: str | None) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=6)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    total, n = max(1, len(data)), max(1, len(words))
    letters = max(1.0, kinds[1] + kinds[2])
    distinct: dict[bytes, int] = {}
    tails = short = 0
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
        tails += w[-1] in _TAILS
        short += len(w) <= 3
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / n, kinds[1] / letters, kinds[3] / total,
        kinds[4] / total, sum(counts[c] for c in b"#$%&*") / total, counts[124] / total, counts[33] / total, kinds[5] / total,
        len(distinct) / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(total / max(1, len(lines))),
        len(words) / (1 + counts[46]), tails / n, short / n, max(distinct.values(), default=0) / n,
    ]


def _feature_rows(batches):
    for batch in batches:
        rows = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


@dataclass
class Additive:
    """Tables of the model: bin edges, one table per feature and per chosen pair."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sum of the bins' entries through the sigmoid."""
        total = np.full(len(x), self.base)
        if self.edges:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[b[:, j]]
            for (i, j), t in zip(self.pairs, self.pair_tables):
                total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Best place to part bins in two, by second-order gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + lam) + (g.sum() - gl)**2 / (h.sum() - hl + lam) - g.sum()**2 / (h.sum() + lam)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    """Values of a tree of depth two over ordered bins."""
    out = np.zeros(len(g))
    _, mid = _cut(g, h, lam)
    for a, z in ((0, mid), (mid, len(g))):
        if a == z:
            continue
        gain, at = _cut(g[a:z], h[a:z], lam)
        for s, e in ((a, a + at), (a + at, z)) if gain > 0 else ((a, z),):
            if s < e:
                out[s:e] = -g[s:e].sum() / (h[s:e].sum() + lam)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Best pair of cuts of a two-way table, and the values of its four parts."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    a, hb = cg[:-1, :-1], ch[:-1, :-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    row_g, row_h, col_g, col_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    parts = [(a, hb), (row_g - a, row_h - hb), (col_g - a, col_h - hb), (cg[-1, -1] - row_g - col_g + a, ch[-1, -1] - row_h - col_h + hb)]
    gain = sum(p**2 / (q + lam) for p, q in parts) - cg[-1, -1]**2 / (ch[-1, -1] + lam)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows, cols, (p, q) in ((slice(0, i + 1), slice(0, j + 1), parts[0]), (slice(0, i + 1), slice(j + 1, None), parts[1]),
                               (slice(i + 1, None), slice(0, j + 1), parts[2]), (slice(i + 1, None), slice(j + 1, None), parts[3])):
        out[rows, cols] = -p[i, j] / (q[i, j] + lam)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6,
        rate: float = 0.15, lam: float = 5.0) -> Additive:
    """Learn an :class:`Additive` model from rows of features and 0/1 labels."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.base)
    slope = lambda: (p := 1 / (1 + np.exp(-total))) - y
    for _ in range(rounds):
        for j, s in enumerate(sizes):
            g = slope()
            p = g + y
            step = rate * _shallow_tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], p * (1 - p), s), lam)
            model.tables[j] += step
            total += step[b[:, j]]
    g = slope()
    p = g + y
    grid = lambda i, j, v: np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, p * (1 - p)), lam)[0], i, j)
                    for i, j in combinations(range(len(sizes)), 2)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:pairs]]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g = slope()
            p = g + y
            step = rate * _quadrants(grid(i, j, g), grid(i, j, p * (1 - p)), lam)[1]
            model.pair_tables[k] += step
            total += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int = MAX_ROWS,
          key: str = "doc_id", text: str = "text") -> Additive:
    """Fit the model on labelled rows for which ``usable``, a condition on the key, holds."""
    bound_text_batches(docs.sparkSession)
    sample = labelled_sample(labels, docs, label, usable, max_rows, key, text).select("label", "text")
    rows = sample.mapInArrow(_feature_rows, "label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever order the rows came in
    return fit(x[order], y[order])


def _scores(model: Additive):
    def kernel(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["key", "score"])
    return kernel


def score(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row."""
    bound_text_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_scores(model), "key long, score double").withColumnRenamed("key", key)
