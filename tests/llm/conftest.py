import pytest
from pyspark.sql import functions as F

TEXTS = [
    None, "", " \n\t ", "one two", "One\ttwo", "one two three", "x", "1234 5678", "é ß 日本語 <|endoftext|> it's  here \n\n end",
    "word " * 30_000, "a" * 5_000, "mail me@example.com or me@example.com, +1 (323) 555-9830, 10.0.0.1 and 4111 1111 1111 1111",
    "the same text of a few words that comes twice", "the same text of a few words that comes twice",
]


@pytest.fixture(scope="session")
def messy(spark):
    """Odd texts, repeated rows, a null id, and columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(TEXTS)] + [(3, "one two", "en", "s", 1), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(1) for c in (
        "key", "_id", "label", "block", "bucket", "kind", "ids", "same", "size", "n", "codes", "v", "host", "word", "numbers", "spans")})


@pytest.fixture(scope="session")
def none(messy):
    return messy.where("1 = 0")
