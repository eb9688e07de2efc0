"""Ids and texts against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from framewright.llm import bpe
from framewright.llm.queries import vocabulary_path


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def test_like_the_library(spark, sf, messy, library):
    docs = messy.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    got = bpe.digests(bpe.encode(docs, vocabulary_path()), vocabulary_path()).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want)


def test_messy_columns_and_empty(messy, none):
    ids = bpe.encode(messy, vocabulary_path())
    assert ids.columns == ["doc_id", "ids"] and ids.count() == messy.count()
    assert bpe.digests(bpe.encode(none, vocabulary_path()), vocabulary_path()).count() == 0


def test_blocks_of_any_size(messy, monkeypatch):
    path = vocabulary_path()
    whole = sorted(map(repr, bpe.encode(messy, path).collect()))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    vocab, rows = bpe.vocabulary(path), []
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"key": [1, 2], "text": ["one two one", None]})
    for _, words, texts in bpe._blocks(iter([batch]), vocab):
        rows += [(k, [i for p in at for i in vocab.merge(words[p].encode())]) for k, at in texts]
    assert [k for k, _ in rows] == [1, 2] and rows[1][1] == [] and len(rows[0][1]) == 3
    assert len(whole) == messy.count()


def test_decode_of_any_ids(spark, library):
    rows = [(1, [0, 50256, 255]), (2, []), (3, None), (4, [188, 222, 10])]
    got = dict(bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), vocabulary_path()).collect())
    assert got[2] == got[3] == ""
    assert got[1] == library.decode([0, 50256, 255], skip_special_tokens=False)


def test_packing():
    v = np.array([0, 1, 127, 128, 16_383, 16_384, 2_000_000, 5])
    assert bpe.unpack(bpe.pack(v)).tolist() == v.tolist() and bpe.pack(v[:0]) == b""
