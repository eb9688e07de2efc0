"""Queries over the given tables, one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, chat, decontamination, jaccard, language, neighbours, phrases, pii, quality, runs, sharding, toxicity, wrappers
from framewright.llm.common import ORACLE, QUERIES, table

__all__ = ["ORACLE", "QUERIES", "load"]


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def load() -> tuple[dict, dict]:
    """Registered queries and oracles."""
    return QUERIES, ORACLE


def vocabulary_path() -> str:
    """Where the public byte-level vocabulary lies; the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op3_bpe_round_trip")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give both digests."""
    path = vocabulary_path()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


def _bucket(key: str, of: int):
    """crc32 of an id as text, modulo ``of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(of))


# Components of links (a, b) over nodes: the smallest node each one reaches.
_REACHED = """
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM pairs UNION SELECT r.node, e.b FROM reach r JOIN pairs e ON e.a = r.other),
low AS (SELECT node, min(other) AS lowest FROM reach GROUP BY node)"""


@_query("op1_pii_spans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, digest of the base spans, all spans."""
    return pii.digest(pii.detect(table(spark, sf_dir, "documents"), masked=False))


@_query("op2_embedding_near_dedup", f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
{_REACHED},
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(lowest, vec_id)) AS component_id,
  vec_id <= coalesce(lowest, vec_id) AS kept
FROM v LEFT JOIN low ON node = vec_id LEFT JOIN n ON a = vec_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of 0.9 or more, and what each component keeps."""
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op4_jaccard_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.shingle = q.shingle AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
{_REACHED}
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(lowest, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON node = w.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose four-word shingles overlap by 85 percent or more."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), n=4, percent=85)


@_query("op5_quality_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled rows that are not held out."""
    docs, out = table(spark, sf_dir, "documents"), _bucket("doc_id", 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~out)
    return quality.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op6_toxicity_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples that are not held out."""
    docs, out = table(spark, sf_dir, "documents"), _bucket("doc_id", 5) == 0
    index = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~out)
    return toxicity.score(docs, index).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@_query("op7_balanced_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    return sharding.balance(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op8_benchmark_leaks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark, with the evidence."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs, out = table(spark, sf_dir, "documents"), _bucket("doc_id", 3) == 1
    profiles = language.train(docs, ~out)
    return language.identify(docs, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@_query("op10_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


@_query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of them with planted periods."""
    found = runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# A text with the template's control strings replaced, as the template lists them.
_ESCAPED = "replace(replace(replace(text, '\\', '\\b'), '### ', '\\o'), '</turn>', '\\c')"


@_query("op11_chat_format", f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS state,
    4 + CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
      ELSE 1 + length(replace({_ESCAPED.replace('text', 'role')}, ': ', '\\t')) END + 2 + length({_ESCAPED}) + 8 AS chars FROM rows),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learnt, CAST(sum(chars) AS BIGINT) AS formatted_chars,
    max_by(role, place) = 'assistant' AND bool_and(CASE state WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
      WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role IN ('assistant', 'tool') ELSE false END) AS valid
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, valid FROM g""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one full of control strings, formatted and read back."""
    text = F.lit("\\### Assistant: </turn> ok")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(two)
    return chat.digests(chat.read_back(chat.formatted(rows)))


@_query("op12_collocations", """
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS ws FROM p),
words AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, m, ws[i:i + m - 1] AS p, count(*) AS f FROM starts, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(ws)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, p, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
scored AS (SELECT c.lang, c.p, c.m, c.k, a, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN words ON words.lang = c.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM scored),
inner_ AS (SELECT DISTINCT s.lang, s.p FROM (SELECT lang, f, unnest(range(1, m - d + 1)) AS i, m - d AS size, p FROM f, (SELECT unnest(range(1, 4)) AS d)
    WHERE m - d >= 2) g
  JOIN f s ON s.lang = g.lang AND s.p = g.p[i:i + size - 1] AND 100 * g.f >= 100 * s.f),
kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM weakest
  WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = weakest.lang AND i.p = weakest.p))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best collocations of two to five words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
