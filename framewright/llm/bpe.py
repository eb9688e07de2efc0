"""Byte-level BPE over a distinct-word table.

Encoding: texts are split in words where they lie; a block of texts (``BLOCK_CHARS``)
keeps its distinct words and each text as positions into them.  Words go to the bucket of
their hash, where every distinct word is merged once, and its ids come back to the block by
position.  What travels is distinct words and packed positions, not texts.

Decoding: the id-to-piece table (one row per vocabulary entry, so bounded) is joined to
the ids as an Arrow gather.

Null texts count as empty and give no ids.  Repeated rows and ids of documents are kept
row by row; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import bound_text_batches, partitions, tidy

# Characters of text that share one block of distinct words.
BLOCK_CHARS = 32_000_000
# Fixed value: the split that byte-level vocabularies of this family are made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# What travels: words of one block and bucket packed in a row, or the positions of one text.
_ROWS = "bucket int, block long, kind int, idx binary, counts binary, payload binary, key long"


def _printable_bytes() -> dict[str, int]:
    """Character of a vocabulary file -> byte: printable Latin-1 stands for itself, the
    other bytes take the code points from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, pieces and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _printable_bytes()
        ids = spec["model"]["vocab"]
        to_bytes = lambda piece: bytes(alphabet[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = [0] * 256
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        size = max([*ids.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for piece, i in ids.items():
            pieces[i] = to_bytes(piece)
            if len(piece) == 1:
                self.byte_ids[alphabet[piece]] = i
        for content, i in self.special.items():
            pieces[i] = content.encode()
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        self.pieces = pa.array(pieces, pa.binary())
        self.decimals = pa.array([f"{i},".encode() for i in range(size)], pa.binary())
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.words = regex.compile(SPLIT)

    def split(self, text: str) -> list[str]:
        """Words of a text in order; a special token is a word of its own."""
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        out: list[str] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self.words.findall(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest-ranked neighbouring pair joins until none is left."""
        special = self.special.get(word.decode("utf-8", "replace"))
        if special is not None:
            return [special]
        ids, merges = [self.byte_ids[b] for b in word], self.merges
        while len(ids) > 1:
            ranked = [merges.get(pair) for pair in zip(ids, ids[1:])]
            best = min((r for r in ranked if r is not None), default=None)
            if best is None:
                break
            joined, i = [], 0
            while i < len(ids):
                if i < len(ranked) and ranked[i] == best:
                    joined.append(best[1])
                    i += 2
                else:
                    joined.append(ids[i])
                    i += 1
            ids = joined
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One copy a worker; the file lies at the same path on every machine."""
    return Vocabulary(path)


class _Places(dict):
    """Word -> position of its first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**21 in one to three bytes of seven bits."""
    v = values.astype(np.uint32)
    length = 1 + (v >= 1 << 7) + (v >= 1 << 14) + (v >= 1 << 21)
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    first = ends - length
    for k in range(4):
        has = length > k
        more = (length[has] > k + 1).astype(np.uint8) << 7
        out[first[has] + k] = ((v[has] >> (7 * k)) & 127).astype(np.uint8) | more
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        has = first + k <= last
        out[has] |= (raw[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], vocab: Vocabulary):
    """(block key, distinct words, [(id, positions)]); the key follows from the texts, so a
    task that runs again names its blocks alike."""
    places, texts, chars, digest = _Places(), [], 0, xxhash.xxh3_64()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            words = vocab.split(text)
            texts.append((key, np.fromiter(map(places.__getitem__, words), np.int32, len(words))))
            digest.update(text)
            digest.update(b"\0%d" % (-1 if key is None else key))
            chars += len(text)
            if chars >= BLOCK_CHARS or len(places) >= 1 << 20:
                yield digest.intdigest() - (1 << 63), list(places), texts
                places, texts, chars, digest = _Places(), [], 0, xxhash.xxh3_64()
    if texts:
        yield digest.intdigest() - (1 << 63), list(places), texts


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "idx": pa.binary(), "counts": pa.binary(),
             "payload": pa.binary(), "key": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))


def _steps(values: np.ndarray) -> bytes:
    """Ascending numbers as packed differences."""
    return pack(np.diff(values, prepend=0))


def _word_rows(path: str, buckets: int):
    """Distinct words of each block, packed per bucket of the word."""
    def kernel(batches):
        for block, words, _ in _blocks(batches, vocabulary(path)):
            spelt = [w.encode() for w in words]
            bucket = np.fromiter(map(zlib.crc32, spelt), np.int64, len(spelt)) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                idx = order[cuts[b]:cuts[b + 1]]
                if len(idx):
                    mine = [spelt[i] for i in idx.tolist()]
                    lengths = np.fromiter(map(len, mine), np.int64, len(mine))
                    rows.append((b, block, 0, _steps(idx), pack(lengths), b"".join(mine), None))
                if len(rows) >= 200:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)
    return kernel


def _text_rows(path: str):
    """Positions of each text in the words of its block."""
    def kernel(batches):
        for block, _, texts in _blocks(batches, vocabulary(path)):
            for at in range(0, len(texts), 500):
                yield _rows([(None, block, 1, None, None, pack(p), k) for k, p in texts[at:at + 500]])
    return kernel


def _merge_words(path: str):
    """Rows arrive sorted by bucket, so a word of any block is merged once."""
    def kernel(batches):
        vocab, at, known = vocabulary(path), None, {}
        width = np.uint16 if len(vocab.pieces) <= 1 << 16 else np.uint32
        for batch in batches:
            rows = []
            for bucket, block, _, idx, counts, payload, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    at, known = bucket, {}
                ids, start = [], 0
                for length in unpack(counts).tolist():
                    word = payload[start:start + length]
                    start += length
                    got = known.get(word)
                    if got is None:
                        known[word] = got = np.array(vocab.merge(word), width)
                    ids.append(got)
                many = np.fromiter(map(len, ids), np.int64, len(ids))
                rows.append((bucket, block, 0, idx, pack(many), np.concatenate(ids).tobytes(), None))
                if len(rows) >= 200:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)
    return kernel


def _table(chunks: list[tuple[bytes, bytes, bytes]], width) -> pa.ListArray:
    """Ids of a block's words by position."""
    if not chunks:
        return pa.array([], pa.list_(pa.int32()))
    idx = np.concatenate([np.cumsum(unpack(c[0])) for c in chunks])
    counts = np.concatenate([unpack(c[1]) for c in chunks])
    flat = np.frombuffer(b"".join(c[2] for c in chunks), width).astype(np.int32)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    _, first = np.unique(idx, return_index=True)
    if len(first) != idx.max() + 1:
        raise RuntimeError("words of a block are missing: read the texts from a stable source")
    return pa.ListArray.from_arrays(offsets, pa.array(flat)).take(pa.array(first))


def _id_rows(path: str):
    """Blocks arrive one after another, words before texts: ids of each text, as rows."""
    def kernel(batches):
        width = np.uint16 if len(vocabulary(path).pieces) <= 1 << 16 else np.uint32
        at, chunks, table = None, [], None
        for batch in batches:
            keys, ids = [], []
            for _, block, kind, idx, counts, payload, key in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    at, chunks, table = block, [], None
                if kind == 0:
                    chunks.append((idx, counts, payload))
                    continue
                if table is None:
                    table, chunks = _table(chunks, width), []
                places = unpack(payload)
                if len(places) and places.max() >= len(table):
                    raise RuntimeError("words of a block are missing: read the texts from a stable source")
                keys.append(key)
                ids.append(table.take(pa.array(places)).flatten())
            if keys:
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids))], ["key", "ids"])
    return kernel


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) per row of ``docs``, ids as the vocabulary at ``path`` gives them.

    Special tokens spelt in a text take their own id.  ``docs`` is read twice and has to be
    a stable source (files, a checkpoint); anything else ends in an error, not in wrong ids.
    """
    spark = docs.sparkSession
    bound_text_batches(spark)
    n = partitions(spark)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # Two input splits a bucket bound the distinct words a task remembers at any size.
    buckets = max(n, 2 * source.rdd.getNumPartitions())
    words = source.mapInArrow(tidy(_word_rows(path, buckets)), _ROWS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    merged = words.mapInArrow(tidy(_merge_words(path)), _ROWS)
    texts = source.mapInArrow(tidy(_text_rows(path)), _ROWS)
    blocks = merged.unionByName(texts).repartition(n, "block").sortWithinPartitions("block", "kind")
    return blocks.mapInArrow(tidy(_id_rows(path)), "key long, ids array<int>").withColumnRenamed("key", key)


def _piece_join(path: str):
    def kernel(batches):
        vocab = vocabulary(path)
        for batch in batches:
            ids = batch.column(1)
            flat = ids.flatten()
            at = np.concatenate(([0], np.cumsum(np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))))
            texts = []
            pieces = vocab.pieces.take(flat)
            ends = np.frombuffer(pieces.buffers()[1], np.int32, len(flat) + 1, pieces.offset * 4)
            data = memoryview(pieces.buffers()[2]) if pieces.buffers()[2] else memoryview(b"")
            for a, b in zip(at[:-1].astype(int), at[1:].astype(int)):
                texts.append(bytes(data[ends[a]:ends[b]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])
    return kernel


def decode(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(key, text) per row of ids: id-to-piece join in order, bytes read as UTF-8 with
    U+FFFD for what is none.  Null or empty ids give an empty text; an id outside the
    vocabulary is an error."""
    bound_text_batches(ids.sparkSession)
    rows = ids.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_piece_join(path), "key long, text string").withColumnRenamed("key", key)


def _digests(path: str):
    """n_tokens and digests of ids and decoded text, batch by batch."""
    def kernel(batches):
        vocab = vocabulary(path)
        join = _piece_join(path)
        for batch in batches:
            ids = batch.column(1)
            lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(int)
            at = np.concatenate(([0], np.cumsum(lengths)))
            text = vocab.decimals.take(ids.flatten())
            ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
            data = memoryview(text.buffers()[2]) if text.buffers()[2] else memoryview(b"")
            spelt = [hashlib.sha256(data[ends[a]:max(ends[a], ends[b] - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:])]
            decoded = next(join(iter([batch]))).column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(spelt),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
    return kernel


def digests(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): decimal ids joined by commas, and the
    text that :func:`decode` gives for them."""
    rows = ids.select(F.col(key).cast("long").alias("key"), F.coalesce(
        F.col(column).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(
        tidy(_digests(path)), "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
