"""Corpus pipeline: five stages over ``documents``, each calling one of the operators.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.  ``run`` writes each stage
as Parquet in the session's shared folder and reads it again as the next one's rows.

Rows whose ``doc_id`` or ``text`` is null: a null text has no language, so stage 1 drops it;
a null id is kept by every stage and never linked or reported.  An empty table passes
through as an empty table; columns beside those of ``documents`` are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontamination, jaccard, language, pii
from framewright.llm.common import shared_folder, table
from framewright.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the rows' own tags and drop rows in none of them: texts that
    are null or without letters."""
    docs = docs.select(*COLUMNS)
    profiles = language.train(docs, F.lit(True))
    kept = language.with_language(docs, profiles).where(F.col("lang_found.lang_pred") != language.UNKNOWN)
    return kept.select("doc_id", "text", F.col("lang_found.lang_pred").alias("lang"), "source", "n_chars")


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies (five words, 0.8)."""
    return jaccard.keep_one(docs.select(*COLUMNS), n=5, percent=80)


def stage_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; ``n_chars`` follows the masked text."""
    masked = pii.mask_text(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode, decode, and return the ids' and the decoded texts' digests per document."""
    path = vocabulary_path()
    return bpe.digests(bpe.encode(docs, path), path)


STAGES = [
    ("language ID", stage_language),
    ("n-gram Jaccard join", stage_near_copies),
    ("benchmark decontamination", stage_leaks),
    ("PII", stage_personal_data),
    ("BPE encoding and decoding", stage_tokens),
]

# Learned models, components and byte-level merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
