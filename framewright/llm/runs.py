"""Periodic runs of words: difference-cover LCE drives harmonic-grid run enumeration.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
as long as ``max(min_length, 3 * q)`` at least, that no neighbouring word extends keeping q.

Words of many texts are laid end to end, each text closed by a word of its own, so one set
of arrays serves them all and no match leaves its text.  Only suffixes at the places of a
difference cover are sorted (by doubling their width); two places are compared word by word
until both stand on the cover, at most ``MODULUS - 1`` words, and the rest is a range minimum
over a sparse table.  A run of period q holds ``max(2q, min_length - q)`` matches in a row, so
a grid of that step meets it; the sum over all q is n log n places.  The work is one pass
over the texts, no shuffle; a task holds one Arrow batch and arrays of ``GROUP_WORDS``
words, or of one text where that is longer.

Null or empty texts have no words and no runs; each of several rows with one key gives its
row; a null key stays null; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import tidy

# A perfect difference set modulo 31 (every difference occurs exactly once).
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)

GROUP_WORDS = 120_000
GRID_PLACES = 1_000_000

SCHEMA = "key long, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _shifts() -> np.ndarray:
    """For residues (a, b): the least step that takes both onto the cover."""
    on = np.isin(np.arange(MODULUS), COVER)
    r = np.arange(MODULUS)
    steps = on[(r[:, None] + r[None, :]) % MODULUS]  # [residue, step]
    return np.argmax(steps[:, None, :] & steps[None, :, :], axis=2)


SHIFTS = _shifts()
PLACE = np.searchsorted(COVER, np.arange(MODULUS))


class CoverLce:
    """Longest common extension of suffixes of ``x``, whose last word occurs nowhere else."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, k = len(x), len(COVER)
        pos = (np.arange(-(-n // MODULUS))[:, None] * MODULUS + np.array(COVER)).ravel()
        pos = pos[pos < n]
        m = len(pos)
        padded = np.concatenate((x, np.full(MODULUS, -1, x.dtype))).astype(">i4")
        wide = np.ascontiguousarray(padded[pos[:, None] + np.arange(MODULUS)]).view(np.dtype((np.void, 4 * MODULUS))).ravel()
        levels = [np.unique(wide, return_inverse=True)[1].ravel()]
        while m and levels[-1].max() + 1 < m:
            ahead = np.full(m, -1, np.int64)
            step = k << (len(levels) - 1)
            ahead[:max(0, m - step)] = levels[-1][step:]
            levels.append(np.unique(levels[-1] * (m + 1) + ahead + 1, return_inverse=True)[1].ravel())
        self.rank = levels[-1]
        self.sparse = self._range_minima(self._neighbours(levels, pos))

    def _neighbours(self, levels: list[np.ndarray], pos: np.ndarray) -> np.ndarray:
        """Common words of sampled suffixes that are next to each other in the order."""
        m, k = len(pos), len(COVER)
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for t in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[t][a[inside]] == levels[t][b[inside]]]
            a[same] += k << t
            b[same] += k << t
            common[same] += MODULUS << t
        first, second = pos[order[:-1]], pos[order[1:]]
        left = np.arange(len(common))
        while len(left):
            i, j = first[left] + common[left], second[left] + common[left]
            inside = (i < len(self.x)) & (j < len(self.x))
            left = left[inside]
            left = left[self.x[i[inside]] == self.x[j[inside]]]
            common[left] += 1
        return common

    @staticmethod
    def _range_minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values.astype(np.int32)]
        width = 1
        while 2 * width <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (i < j) have in common, place by place."""
        shift = SHIFTS[i % MODULUS, j % MODULUS]
        common = np.zeros(len(i), np.int64)
        left, arrived = np.arange(len(i)), []
        for t in range(MODULUS):
            there = shift[left] == t
            arrived.append(left[there])
            left = left[~there]
            if not len(left):
                break
            left = left[self.x[i[left] + t] == self.x[j[left] + t]]
            common[left] = t + 1
        far = np.concatenate(arrived)
        if len(far):
            a, b = i[far] + shift[far], j[far] + shift[far]
            r = self.rank[a // MODULUS * len(COVER) + PLACE[a % MODULUS]]
            s = self.rank[b // MODULUS * len(COVER) + PLACE[b % MODULUS]]
            low, high = np.minimum(r, s), np.maximum(r, s)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(far), np.int64)
            for t in np.unique(level).tolist():
                of = np.flatnonzero(level == t)
                least[of] = np.minimum(self.sparse[t][low[of]], self.sparse[t][high[of] - (1 << t)])
            common[far] += least
        return common


def _grid(starts: list[int], sizes: list[int], min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the grids of all texts, in pieces of bounded size."""
    held, many = [], 0
    for at, n in zip(starts, sizes):
        low = 1
        while low <= n // 3 and n >= min_length:
            high = min(n // 3, low + max(1, GRID_PLACES * low // n))
            q = np.arange(low, high + 1)
            step = np.maximum(2 * q, min_length - q)
            count = -(-(n - q) // step)
            index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            held.append((at + index * np.repeat(step, count), np.repeat(q, count)))
            many += len(index)
            low = high + 1
            if many >= GRID_PLACES:
                yield tuple(map(np.concatenate, zip(*held)))
                held, many = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _least_periods(found: list[np.ndarray]) -> np.ndarray:
    """(start, end, period) rows in order; of equal stretches the one with the least period."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def find_runs(texts: list[np.ndarray], min_length: int = 24) -> list[np.ndarray]:
    """(start, end, period) rows per text of word numbers, by start, then period."""
    sizes = [len(t) for t in texts]
    words = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    parts, starts, at = [np.array([words])], [], 1
    for i, t in enumerate(texts):
        parts += [t, np.array([words + 1 + i])]
        starts.append(at)
        at += len(t) + 1
    x = np.concatenate(parts).astype(np.int32)
    n, found, pending = len(x), [np.empty((0, 3), np.int64)], []
    for place, q in _grid(starts, sizes, min_length):
        same = x[place] == x[place + q]
        if same.any():
            pending.append((place[same], q[same]))
    if pending:
        after, before = CoverLce(x), CoverLce(x[::-1].copy())
        for place, q in pending:
            # Matches from the place on, and before it as seen from the other end.
            ahead = after(place, place + q)
            behind = before(n - place - q, n - place)
            enough = ahead + behind >= np.maximum(2 * q, min_length - q)
            s = (place - behind)[enough]
            e = (place + q + ahead)[enough]
            found.append(_least_periods([found.pop(), np.stack((s, e, q[enough]), axis=1)]))
    rows = found[0]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.array(starts + [n]))
    return [rows[a:b] - np.array([at, at, 0]) for a, b, at in zip(cuts[:-1], cuts[1:], starts)]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """(start, length, period) with the greatest length / period, exactly; then the smallest
    start, then the smallest period."""
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


def _kernel(min_length: int):
    def rows(keys: list, split: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        out: list[tuple] = []
        for key, words, runs in zip(keys, split, find_runs(numbers, min_length)):
            listed = [(s, e - s, q) for s, e, q in runs.tolist()]
            if listed:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                words_kept = [words[i] for i in kept.tolist()]
            else:
                words_kept = words
            best = greatest(listed)
            named = [dict(zip(("start", "length", "period"), r)) for r in listed]
            out.append((key, len(words), named, best and dict(zip(("start", "length", "period"), best)), b" ".join(words_kept).decode()))
        types = (pa.int64(), pa.int64(), pa.list_(_RUN), _RUN, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["key", "n_words", "runs", "best", "collapsed"])

    def kernel(batches):
        keys, split, numbers, ids, many = [], [], [], {}, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                keys.append(key)
                split.append(words)
                numbers.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
                many += len(words) + 1
                if many >= GROUP_WORDS:
                    yield rows(keys, split, numbers)
                    keys, split, numbers, ids, many = [], [], [], {}, 0
        if keys:
            yield rows(keys, split, numbers)
    return kernel


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 24) -> DataFrame:
    """(key, n_words, runs, best, collapsed) per row of ``docs``: all runs by start, then
    period; the one of greatest exponent; and the text's words less those that some run
    holds after its first period, joined by one space.  Words are what ASCII white space
    leaves apart."""
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(tidy(_kernel(min_length)), SCHEMA).withColumnRenamed("key", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periods put into a tenth of the texts: with h the crc32 of the id and
    g = h div 10, where h is a multiple of 10, words from a = g % n on repeat the
    1 + (n - a) div (3 + g % 8) words found there.  A null id counts as the empty text."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    words = F.array_remove(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), "")
    cut = docs.withColumns({"_h": h, "_words": F.when(h % 10 == 0, words)}).withColumns(
        {"_n": F.size("_words"), "_g": F.floor(F.col("_h") / 10)})
    a = F.expr("cast(_g % _n as int)")
    cut = cut.withColumn("_a", F.when(F.col("_n") > 0, a))
    cut = cut.withColumn("_p", F.expr("cast(1 + floor((_n - _a) / (3 + _g % 8)) as int)"))
    repeated = F.expr("""concat_ws(' ', slice(_words, 1, _a),
        slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast(ceil((_n - _a) / _p) as int))), 1, _n - _a))""")
    return cut.withColumn(text, F.when(F.col("_n") > 0, repeated).otherwise(F.col(text))).select(*docs.columns)
