"""The pipeline against a plain walk over the same rows."""

import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import decontamination, pii
from framewright.llm.queries import vocabulary_path
from tests.llm.test_jaccard import brute


def walk(docs, items):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what stays."""
    rows = {r.doc_id: r.text for r in docs if r.text and any(c.isalpha() for c in r.text)}
    lead = brute(list(rows.items()), 5, 80)
    rows = {d: t for d, t in rows.items() if lead[d][1] == d}
    spelt = [b" " + b" ".join(decontamination.tokens(i.text)) + b" " for i in items]
    rows = {d: t for d, t in rows.items() if not any(s in b" " + b" ".join(decontamination.tokens(t)) + b" " for s in spelt)}
    library = Tokenizer.from_file(vocabulary_path())
    for d, t in rows.items():
        text = pii.mask(t, pii.find_spans(t))
        ids = library.encode(text, add_special_tokens=False).ids
        yield d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_run_like_a_plain_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted(walk(docs, spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_columns_and_take_odd_rows(spark, messy, none, sf):
    for docs in (messy, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert tuple(out.columns) == corpus_pipeline.COLUMNS
                docs = out
            assert out.count() <= messy.count()
        assert (out.count() > 0) == (docs.count() > 0)
    assert Counter(n for n, _ in corpus_pipeline.STAGES).most_common(1)[0][1] == 1 and len(corpus_pipeline.STAGES) == 5
