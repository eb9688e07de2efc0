"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut in passages of ``PASSAGE`` words, half overlapping.  Their words
   are the vocabulary; document frequencies are counted over all documents.
2. A randomised SVD of the TF-IDF rows of those passages and of all documents gives the
   latent space: every task adds up what its rows send through a random basis, the sums are
   made orthonormal, twice, and a small matrix gives the axes.  A document is one row;
   documents weigh together ``DOCS_SHARE`` as much as the passages, however many they are.
   Texts travel on as numbers of the vocabulary's words, checkpointed once.
3. All passages of all documents are laid into the space and compared by cosine with all
   passages of the benchmark, in tiles (a stated query set against all rows).
4. Around a candidate passage, the words of the item are aligned with those of the document
   by longest common subsequence.  A document leaks an item if the share of the item found
   in order reaches ``strong``, or ``weak`` with the answer, the item's last sentence, found.

A benchmark of more than ``SLICE_WORDS`` words is taken in slices, so what a task holds is
bounded.  Words are runs of letters and digits in lower case.  Null and empty texts and
items match nothing; repeated rows of either table give one row per pair of ids; rows
without id are not reported.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import bound_text_batches, tidy
from framewright.session import cut_lineage

PASSAGE = 32
RANK = 80
COSINE = 0.45
STRONG = 0.75
WEAK = 0.6
SLICE_WORDS = 20_000
# Weight of all documents together in the decomposition, next to the benchmark's passages.
DOCS_SHARE = 0.5
# Passages of which the space keeps less than this share of their length count as if it kept it.
LEAST_KEPT = 0.1
# Words of the vocabulary whose sums travel together.
BLOCK_WORDS = 512
# Widths of the windows in which an item is looked for, in lengths of the item.
WIDTHS = (1.25, 2.0)
# Items of a benchmark that one job brings to the driver.
PAGE_ITEMS = 500
# Words of a document that are laid into the space together.
TILE_WORDS = 4_096

# ASCII but letters and digits to blanks; other bytes stay, as they spell letters.
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANK).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence of an item that has several, else of its last third."""
    words = tokens(text)
    cut = max(text.rstrip().rstrip(".!?\"')").rfind(c) for c in ".!?\n:")
    last = tokens(text[cut + 1:]) if cut >= 0 else []
    return last if last and len(last) < len(words) else words[len(words) * 2 // 3:]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per word of ``a``."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@dataclass
class Space:
    """Latent space of one slice of a benchmark."""

    vocabulary: dict[bytes, int]
    axes: np.ndarray            # idf-weighted axes, vocabulary x rank, and a zero row for other words
    squares: np.ndarray         # squared idf of the words, their mean for words of no item: it does not grow with the table
    passages: np.ndarray        # unit rows of the benchmark's passages
    item_of: np.ndarray         # item of each passage
    items: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    member: np.ndarray          # items x (vocabulary and one): the words of each item

    def lay(self, at: np.ndarray) -> np.ndarray:
        """Rows of the half overlapping passages of a text's word numbers, by the length of
        their whole TF-IDF rows: what lies outside the space, words the benchmark never
        uses above all, makes a passage less alike to any item."""
        half, rank = PASSAGE // 2, self.axes.shape[1]
        count = max(1, -(-len(at) // half))
        full = np.full(count * half, len(self.vocabulary), np.int64)
        full[:len(at)] = at
        halves = np.einsum("ijk->ik", np.take(self.axes, full, axis=0).reshape(count, half, rank))
        squares = self.squares[full]
        squares[len(at):] = 0
        squares = squares.reshape(count, half).sum(axis=1)
        if count > 1:
            halves, squares = halves[:-1] + halves[1:], squares[:-1] + squares[1:]
        # Positions are summed as if no word came twice; the projection itself bounds the rest.
        inside = np.sqrt(np.einsum("ij,ij->i", halves, halves))
        return halves / np.maximum(np.maximum(np.sqrt(squares), inside), 1e-9)[:, None]


def _number_rows(vocabulary: dict[bytes, int]):
    """Texts as packed numbers of their words, the vocabulary's size for all other words."""
    other, kind = len(vocabulary), _width(vocabulary)

    def kernel(batches):
        get = vocabulary.get
        for batch in batches:
            packed = []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                packed.append(np.fromiter(map(get, words, repeat(other)), kind, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "numbers"])
    return kernel


def _width(vocabulary: dict) -> type:
    return np.uint16 if len(vocabulary) < 1 << 16 else np.uint32


def _passage_rows(at: np.ndarray, other: int) -> list[np.ndarray]:
    half = PASSAGE // 2
    last = max(1, -(-len(at) // half) - 1)
    return [r for k in range(last) if len(r := (p := at[k * half:k * half + PASSAGE])[p < other])]


def _texts_with_words(size: int, kind: type):
    """Per task: texts that hold each word of the vocabulary; the last number counts texts."""
    def kernel(batches):
        count = np.zeros(size + 1, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                seen = np.unique(np.frombuffer(packed, kind))
                count[seen[seen < size]] += 1
                count[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count)), pa.int64()), pa.array(count)], ["word", "texts"])
    return kernel


def _sent(rows, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum over word numbers of a row of its unit TF-IDF row times what that sends through ``basis``."""
    total = np.zeros_like(basis)
    for row in rows:
        tf = np.bincount(row)
        words = np.flatnonzero(tf)
        if len(words):
            w = tf[words] * idf[words]
            w /= np.linalg.norm(w)
            total[words] += np.outer(w, w @ basis[words])
    return total


def _through(idf: np.ndarray, basis: np.ndarray, kind: type):
    """Per task: what its documents send through ``basis``, packed in blocks of ``BLOCK_WORDS`` words."""
    def rows(batches):
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                numbers = np.frombuffer(packed, kind)
                yield numbers[numbers < len(basis)]

    def kernel(batches):
        total = _sent(rows(batches), idf, basis)
        blocks = [(k, total[k:k + BLOCK_WORDS].tobytes()) for k in range(0, len(total), BLOCK_WORDS) if total[k:k + BLOCK_WORDS].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int64()), pa.array([b for _, b in blocks], pa.binary())], ["word", "block"])
    return kernel


def _sum_blocks(batches):
    """Blocks that begin with the same word, added up; they arrive in order."""
    at, total = None, None
    for batch in batches:
        for word, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if word != at:
                if at is not None:
                    yield _block(at, total)
                at, total = word, np.zeros(len(block) // 8)
            total += np.frombuffer(block)
    if at is not None:
        yield _block(at, total)


def _block(word: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([word], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["word", "block"])


def _power(numbered: DataFrame, kind: type, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times ``basis`` for the matrix A of documents, added up by tasks; the driver takes
    one packed block per ``BLOCK_WORDS`` words of the slice, all of them in one job: together
    they are as large as ``basis``."""
    parts = numbered.select("numbers").mapInArrow(tidy(_through(idf, basis, kind)), "word long, block binary")
    tasks = min(max(1, -(-len(basis) // BLOCK_WORDS)), numbered.sparkSession.sparkContext.defaultParallelism)
    summed = parts.repartition(tasks, "word").coalesce(tasks).sortWithinPartitions("word").mapInArrow(
        tidy(_sum_blocks), "word long, block binary")
    out = np.zeros_like(basis)
    for word, block in summed.collect():
        out[word:word + BLOCK_WORDS] = np.frombuffer(block).reshape(-1, basis.shape[1])
    return out


def vocabulary_of(items: list[tuple[int, str]]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted({w for _, t in items for w in tokens(t)}))}


def latent_space(numbered: DataFrame, items: list[tuple[int, str]], vocabulary: dict[bytes, int], rank: int = RANK,
                 seed: int = 8) -> Space:
    """Fit the space of one slice of items from (key, numbers) of all documents."""
    n, kind = len(vocabulary), _width(vocabulary)
    # A task sends a sum as large as the vocabulary whatever it read, so there are as many tasks
    # as cores: what travels does not grow with the documents or the files they lie in.
    numbered = numbered.coalesce(numbered.sparkSession.sparkContext.defaultParallelism)
    words = [np.array([vocabulary[w] for w in tokens(t)], np.int64) for _, t in items]
    held = numbered.select("numbers").mapInArrow(_texts_with_words(n, kind), "word long, texts long").groupBy("word").agg(
        F.sum("texts").alias("texts"))
    count = np.zeros(n + 1)
    for word, texts in held.collect():
        count[word] = texts
    idf = np.log((count[n] + 1) / (count[:n] + 1)) + 0.1
    own = [r for ws in words for r in _passage_rows(ws, n)]
    share = DOCS_SHARE * len(own) / max(1.0, count[n])

    def power(basis: np.ndarray) -> np.ndarray:
        return _sent(own, idf, basis) + share * _power(numbered, kind, idf, basis)

    basis = np.random.default_rng(seed).standard_normal((n, min(n, rank + 16)))
    for _ in range(2):
        basis, _ = np.linalg.qr(power(basis))
    small = basis.T @ power(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    axes = (basis @ turn[:, np.argsort(-values)[:rank]]) * idf[:, None]
    squares = np.append(idf ** 2, np.mean(idf ** 2)).astype(np.float32)
    space = Space(vocabulary, np.vstack([axes, np.zeros(axes.shape[1])]).astype(np.float32), squares, np.empty((0, 0)), np.empty(0, np.int64),
                  [i for i, _ in items], [ws.tolist() for ws in words], [[vocabulary[w] for w in answer_of(t)] for _, t in items],
                  np.zeros((len(items), n + 1), bool))
    for member, ws in zip(space.member, words):
        member[ws] = True
    laid = [space.lay(ws) for ws in words]
    passages = np.concatenate(laid)
    # A copy of a passage keeps the share of its length that the space keeps of the passage:
    # rows are scaled so that the copy comes to 1.
    norm = np.linalg.norm(passages, axis=1, keepdims=True)
    space.passages = np.where(norm > 0, passages / np.maximum(norm, LEAST_KEPT) ** 2, 0).astype(np.float32)
    space.item_of = np.repeat(np.arange(len(items)), [len(x) for x in laid])
    return space


def _aligned(space: Space, words: np.ndarray, start: int, end: int, item: int, strong: float, weak: float) -> tuple[float, float] | None:
    """(share, share of the answer) of the window near a candidate that holds most of the item
    in order, among those that make a leak; None where none does.

    Windows of each of ``WIDTHS`` step by a quarter of the item, so a copy is whole in one, and
    so is a paraphrase that takes up to 1.75 lengths.  The answer counts in any window."""
    own, answer = space.words[item], space.answers[item]
    stretch = words[max(0, start - len(own)):end + 2 * len(own)]
    # No order reaches a share that the words alone do not.
    if np.count_nonzero(space.member[item][stretch]) < weak * len(own):
        return None
    near = stretch.tolist()
    held = set(near)
    if sum(w in held for w in own) < weak * len(own):
        return None
    step, best = max(1, len(own) // 4), None
    for width in WIDTHS:
        size = max(len(own) + 2, int(width * len(own)))
        for at in range(0, max(1, len(near) - size + step), step):
            window = near[at:at + size]
            share = common_subsequence(own, window) / len(own)
            if share >= weak and (best is None or share >= best[0]):
                found = common_subsequence(answer, window) / max(1, len(answer))
                if share >= strong or found >= 0.999:
                    best = max(best or (0.0, 0.0), (share, found))
    return best


def _candidates(space: Space, at: np.ndarray, cosine: float):
    """(item, first word, last word, cosine) of passages that come near one of an item's."""
    half, last = PASSAGE // 2, {}
    for a in range(0, max(1, len(at)), TILE_WORDS):
        near = space.lay(at[a:a + TILE_WORDS + half]) @ space.passages.T
        hit = np.flatnonzero(near >= cosine)
        for r, c in zip(*(x.tolist() for x in np.divmod(hit, near.shape[1]))):
            start, item = a + r * half, int(space.item_of[c])
            # What begins in the very next passage lies in the stretch that this one opens.
            if start > last.get(item, -PASSAGE) + half:
                last[item] = start
                yield item, start, start + PASSAGE, float(near[r, c])


def _leaks(space: Space, cosine: float, strong: float, weak: float):
    kind = _width(space.vocabulary)

    def kernel(batches):
        for batch in batches:
            out = []
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(packed, kind).astype(np.int64)
                if not len(words):
                    continue
                best: dict[int, tuple] = {}
                for item, start, end, value in _candidates(space, words, cosine):
                    found = _aligned(space, words, start, end, item, strong, weak)
                    if found is not None:
                        best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (*found, min(1.0, value)))
                out += [(key, space.items[i], v, s, a) for i, (s, a, v) in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                    ["key", "item_id", "cosine", "lcs_share", "answer_share"])
    return kernel


def _in_order(rows: DataFrame):
    """Distinct (i, t) in order, a job per ``PAGE_ITEMS`` of them however many partitions they lie in."""
    rows = cut_lineage(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism))
    after = F.lit(True)
    while page := rows.where(after).orderBy("i", "t").limit(PAGE_ITEMS).collect():
        yield from page
        if len(page) < PAGE_ITEMS:
            return
        i, t = page[-1]
        after = (F.col("i") > i) | ((F.col("i") == i) & (F.col("t") > t))


def slices(benchmark: DataFrame, item_key: str = "item_id", text: str = "text", slice_words: int = SLICE_WORDS):
    """Items with words, in slices of about ``slice_words`` words, read one after another."""
    rows = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where(
        "i is not null and t is not null").distinct()
    held: list[tuple[int, str]] = []
    size = 0
    for r in _in_order(rows):
        n = len(tokens(r["t"]))
        if not n:
            continue
        if held and size + n > slice_words:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, strong: float = STRONG, weak: float = WEAK,
               rank: int = RANK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, cosine, lcs_share, answer_share): one row per document and item it leaks."""
    bound_text_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null")
    schema = "key long, item_id long, cosine double, lcs_share double, answer_share double"
    out = None
    for items in slices(benchmark):
        vocabulary = vocabulary_of(items)
        numbered = cut_lineage(source.mapInArrow(tidy(_number_rows(vocabulary)), "key long, numbers binary"))
        space = latent_space(numbered, items, vocabulary, rank)
        part = numbered.mapInArrow(tidy(_leaks(space, cosine, strong, weak)), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    best = out.groupBy("key", "item_id").agg(F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("b"))
    return best.select(F.col("key").alias(key), "item_id", F.col("b.cosine").alias("cosine"), F.col("b.lcs_share").alias("lcs_share"),
                       F.col("b.answer_share").alias("answer_share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that leak no item; rows without a key stay."""
    return docs.join(find_leaks(docs, benchmark, key=key, text=text).select(key).distinct().hint("shuffle_hash"), key, "left_anti")
