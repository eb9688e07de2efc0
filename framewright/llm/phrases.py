"""Collocations: phrases that come together more often than their parts.

1. Texts are lower-cased, cut in pieces and packed into blocks of one language, written once
   as a table in the shared folder.
2. Every block counts its own phrases of 1 to 5 words and sends, per hash partition, the
   hashes and counts.  A partition merges these into one Misra-Gries summary.  Its capacity is
   ``SLACK`` times the partition's mass divided by the threshold, so that what its decrements
   take from any phrase stays below the threshold; the decrements are added up, and a summary
   that took too much is made again with twice the room.  Every phrase with a count of the
   threshold or more is left over, and the block is told so, one bit per hash it sent.
3. The second pass counts the phrases left over in each block exactly, by their words, adds
   them up within the task and sends them, packed, to their hash partition, which adds up
   again and drops what is below the threshold.

Cuts, scores and containment are joins of the table of frequent phrases with itself: parts
of a frequent phrase are frequent too, so it holds them all.  Products are decimals.

A task holds one block (``BLOCK_BYTES``) and ``HELD_PHRASES`` counts, or one hash partition
(about ``PARTITION_PHRASES`` hashes; they spread evenly, and a hot phrase is one entry a block).
Hashes are 32 bits within a partition; a collision only adds a phrase to the second pass.

Null texts are empty, a null language is ``und``, repeated rows count again, ids and other
columns are not read, and an empty table or one without frequent phrases gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import batches_of, partitions, shared_folder, tidy
from framewright.session import cut_lineage

# The bytes that end a piece, and those between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BETWEEN = b" \t"

LONGEST = 5
BLOCK_BYTES = 4_000_000
PARTITION_PHRASES = 4_000_000
HELD_PHRASES = 300_000
SLACK = 4

_NORMAL = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + BETWEEN, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" " * len(BETWEEN))
_BLOCKS = "block long, lang string, words long, pieces binary"
_ROWS = "bucket int, block long, kind int, lang string, payload binary"


class _Places(dict):
    """Number of each word, in the order of first use; 0 and 1 are gap and break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _words(pieces: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, their numbers in order, words up to the end of the piece from each one on)."""
    places = _Places({b"": 0, b"\n": 1})
    tokens = pieces.replace(b"\n", b" \n ").split(b" ")
    numbers = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
    numbers = numbers[numbers > 0]
    ends = numbers == 1
    piece = np.cumsum(ends)[~ends]
    ids = numbers[~ends] - 2
    room = np.cumsum(np.bincount(piece))[piece] - np.arange(len(ids)) if len(ids) else ids
    return list(places)[2:], ids, room


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finisher of a published generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(lang: str, words: list[bytes], ids: np.ndarray, room: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, keys) for phrases of 1, 2, ... words: hash partition above 32 bits of hash."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))[ids]
    places, run = np.arange(len(ids)), word
    for n in range(1, LONGEST + 1):
        if n > 1:
            enough = room[places] >= n
            places, run = places[enough], run[enough]
            run = run * np.uint64(0x9E3779B97F4A7C15) + word[places + n - 1]
        h = _mixed(run + np.uint64(n))
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        yield places, bucket << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and how often each occurs, by one sort."""
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal texts of one language after another, broken at line ends."""
    held: dict[str, list[bytes]] = {}
    size, number = 0, TaskContext.get().partitionId() << 32

    def flush():
        nonlocal number
        for lang, texts in held.items():
            pieces = b"\n".join(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([len(pieces.split())], pa.int64()),
                pa.array([pieces], pa.binary())], ["block", "lang", "words", "pieces"])
            number += 1

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if text:
                held.setdefault(lang.as_py(), []).append(text.encode().translate(_NORMAL))
                size += len(held[lang.as_py()][-1])
            if size >= BLOCK_BYTES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one at a time: their payloads are large."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "block", "kind", "lang", "payload"])


def _pack(low: np.ndarray, counts: np.ndarray) -> bytes:
    """32-bit hashes and counts: a byte a count, larger ones listed behind."""
    large = np.flatnonzero(counts > 255)
    return b"".join((
        np.array([len(low), len(large)], np.uint32).tobytes(), low.astype(np.uint32).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(),
        large.astype(np.uint32).tobytes(), counts[large].astype(np.uint64).tobytes()))


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(payload, np.uint32, 2).tolist()
    low = np.frombuffer(payload, np.uint32, n, 8)
    counts = np.frombuffer(payload, np.uint8, n, 8 + 4 * n).astype(np.int64)
    large = np.frombuffer(payload, np.uint32, m, 8 + 5 * n)
    counts[large] = np.frombuffer(payload, np.uint64, m, 8 + 5 * n + 4 * m).astype(np.int64)
    return low, counts


def _count_hashes(buckets: int):
    def kernel(batches):
        for batch in batches:
            for block, lang, pieces in _each(batch):
                keys, counts = _distinct([k for _, k in _hashes(lang, *_words(pieces), buckets)])
                cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                rows = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    here = slice(cuts[b], cuts[b + 1])
                    rows.append((b, block, 0, None, _pack(keys[here] & np.uint64(0xFFFFFFFF), counts[here])))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
    return kernel


class Summary:
    """Mergeable Misra-Gries counters.  ``lost`` bounds what any count is short of the truth."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > off], counts[counts > off] - off
            self.lost += off
        self.keys, self.counts = keys, counts

    def may_reach(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.lost >= threshold]


def summarise(payloads: list[bytes], threshold: int, slack: int = SLACK) -> np.ndarray:
    """Ascending hashes among which is every one with ``threshold`` or more occurrences."""
    mass = sum(int(_unpack(p)[1].sum()) for p in payloads)
    capacity = slack * mass // threshold + 1
    while True:
        summary, held, many = Summary(capacity), [], 0
        for payload in payloads:
            piece = _unpack(payload)
            held.append(piece)
            many += len(piece[0])
            if many >= max(capacity, 200_000):
                summary.merge(*map(np.concatenate, zip(*held)))
                held, many = [], 0
        if held:
            summary.merge(*map(np.concatenate, zip(*held)))
        if summary.lost < threshold:
            return summary.may_reach(threshold)
        capacity *= 2


def _tell_blocks(threshold: int):
    """One hash partition after another: which of the hashes each block sent are left over."""
    def answers(bucket: int, blocks: list[int], payloads: list[bytes]):
        left = summarise(payloads, threshold)
        rows = []
        for block, payload in zip(blocks, payloads):
            low = _unpack(payload)[0]
            at = np.minimum(np.searchsorted(left, low), max(0, len(left) - 1))
            bits = left[at] == low if len(left) else np.zeros(len(low), bool)
            if bits.any():
                rows.append((bucket, block, 0, None, np.packbits(bits).tobytes()))
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def kernel(batches):
        at, blocks, payloads = None, [], []
        for batch in batches:
            for bucket, block, _, _, payload in _each(batch):
                if bucket != at:
                    if blocks:
                        yield from answers(at, blocks, payloads)
                    at, blocks, payloads = bucket, [], []
                blocks.append(block)
                payloads.append(payload)
        if blocks:
            yield from answers(at, blocks, payloads)
    return kernel


def _left_over(keys: np.ndarray, told: list[tuple[int, bytes]]) -> np.ndarray:
    """The block's hashes that its partitions kept."""
    kept = [keys[:0]]
    for bucket, bits in told:
        a, b = np.searchsorted(keys, np.array([bucket, bucket + 1], np.uint64) << np.uint64(32))
        kept.append(keys[a:b][np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)])
    return np.sort(np.concatenate(kept))


def exact_counts(lang: str, pieces: bytes, told: list[tuple[int, bytes]], buckets: int) -> Iterator[tuple[int, bytes, int]]:
    """(hash partition, phrase, occurrences) in the block of the phrases left over, told apart by their words.

    A phrase is looked at only where its first words and its last word are left over too,
    which holds for every frequent one."""
    words, ids, room = _words(pieces)
    found = list(_hashes(lang, words, ids, room, buckets))
    left = _left_over(_distinct([k for _, k in found])[0], told)
    if not len(left):
        return
    number = np.full(len(ids) + 1, -1, np.int64)  # of the phrase that starts at a place, by its words
    single = number
    for n, (places, keys) in enumerate(found, 1):
        if n > 1:
            near = (number[places] >= 0) & (single[places + n - 1] >= 0)
            places, keys = places[near], keys[near]
        at = np.minimum(np.searchsorted(left, keys), len(left) - 1)
        here = left[at] == keys
        places, keys = places[here], keys[here]
        spelt = ids[places] if n == 1 else number[places] << 32 | single[places + n - 1]
        _, first, inverse, many = np.unique(spelt, return_index=True, return_inverse=True, return_counts=True)
        number = np.full(len(ids) + 1, -1, np.int64)
        number[places] = inverse
        single = number if n == 1 else single
        for bucket, start, count in zip((keys[first] >> np.uint64(32)).tolist(), places[first].tolist(), many.tolist()):
            yield bucket, b" ".join(words[i] for i in ids[start:start + n].tolist()), count


def _count_rows(held: dict[str, dict[int, dict[bytes, int]]]) -> Iterator[pa.RecordBatch]:
    """Phrases and counts of a task, a row per language and hash partition: phrases hold no line end."""
    rows = []
    for lang, parts in held.items():
        for bucket, counts in parts.items():
            numbers = np.fromiter(counts.values(), np.int64, len(counts))
            rows.append((bucket, None, 2, lang, np.int64(len(counts)).tobytes() + numbers.tobytes() + b"\n".join(counts)))
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _count_phrases(buckets: int):
    """Blocks one after another, what they were told before their texts; counts are added up within the task."""
    def kernel(batches):
        at, told, held, many = None, [], {}, 0
        for batch in batches:
            for bucket, block, kind, lang, payload in _each(batch):
                if block != at:
                    at, told = block, []
                if kind == 0:
                    told.append((bucket, payload))
                    continue
                parts = held.setdefault(lang, {})
                for to, phrase, count in exact_counts(lang, payload, told, buckets):
                    counts = parts.setdefault(to, {})
                    many += phrase not in counts
                    counts[phrase] = counts.get(phrase, 0) + count
                if many >= HELD_PHRASES:
                    yield from _count_rows(held)
                    held, many = {}, 0
        yield from _count_rows(held)
    return kernel


def _add_up(threshold: int):
    """One language of a hash partition after another: phrases with all their occurrences."""
    def frequent(lang: str, counts: dict[bytes, int]):
        many = [(p, c) for p, c in counts.items() if c >= threshold]
        if many:
            phrases, f = zip(*many)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(f), pa.string()), pa.array([p.count(b" ") + 1 for p in phrases], pa.int32()),
                pa.array([p.decode() for p in phrases], pa.string()), pa.array(f, pa.int64())], ["lang", "size", "phrase", "f"])

    def kernel(batches):
        at, counts = None, {}
        for batch in batches:
            for bucket, _, _, lang, payload in _each(batch):
                if (bucket, lang) != at:
                    if at is not None:
                        yield from frequent(at[1], counts)
                    at, counts = (bucket, lang), {}
                n = int(np.frombuffer(payload, np.int64, 1)[0])
                for phrase, count in zip(payload[8 + 8 * n:].split(b"\n"), np.frombuffer(payload, np.int64, n, 8).tolist()):
                    counts[phrase] = counts.get(phrase, 0) + count
        if at is not None:
            yield from frequent(at[1], counts)
    return kernel


def frequent_phrases(docs: DataFrame, threshold: int = 100, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of 1 to 5 words with f >= threshold, and
    (lang, n) words of each language."""
    spark = docs.sparkSession
    n = partitions(spark)
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    source.mapInArrow(tidy(_pack_blocks), _BLOCKS).write.parquet(folder)
    blocks = spark.read.schema(_BLOCKS).parquet(folder)
    totals = blocks.groupBy("lang").agg(F.sum("words").alias("n")).where("n > 0")
    words = blocks.agg(F.sum("words")).first()[0] or 0
    buckets = max(n, -(-words * LONGEST // PARTITION_PHRASES))

    packed = blocks.select("block", "lang", "pieces")
    sent = packed.mapInArrow(tidy(_count_hashes(buckets)), _ROWS)
    told = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_tell_blocks(threshold)), _ROWS)
    texts = packed.select(F.lit(None).cast("int").alias("bucket"), "block", F.lit(1).alias("kind"), "lang", F.col("pieces").alias("payload"))
    counted = told.unionByName(texts).repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(
        tidy(_count_phrases(buckets)), _ROWS)
    frequent = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(
        tidy(_add_up(threshold)), "lang string, size int, phrase string, f long")
    with batches_of(spark, 32):  # rows of a megabyte
        return cut_lineage(frequent), totals


def collocations(
    docs: DataFrame, threshold: int = 100, top: int = 2000, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to 5 words.

    A phrase scores ``floor(1000 a n / (l r))`` at its weakest cut.  A phrase inside a longer
    frequent one that comes as often is left out."""
    frequent, totals = frequent_phrases(docs, threshold, text, lang)
    candidates = frequent.where("size >= 2").withColumn("_words", F.split("phrase", " "))
    part = frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part"))

    cut = candidates.select("lang", "phrase", "_words", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k", F.expr("concat_ws(' ', slice(_words, 1, k))").alias("first"),
        F.expr("concat_ws(' ', slice(_words, k + 1, size - k))").alias("rest"))
    cut = cut.join(part.select("lang", F.col("part").alias("first"), F.col("of_part").alias("l")), ["lang", "first"])
    cut = cut.join(part.select("lang", F.col("part").alias("rest"), F.col("of_part").alias("r")), ["lang", "rest"])
    cut = cut.join(totals, "lang").withColumn("score", F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    weakest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")

    # One word longer is enough: between a phrase and a longer one that comes as often all others do too.
    longer = candidates.where("size >= 3").select("lang", "f", F.explode(F.expr(
        "array(concat_ws(' ', slice(_words, 1, size - 1)), concat_ws(' ', slice(_words, 2, size - 1)))")).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where("outer is null or outer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
