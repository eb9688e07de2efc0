"""Compare a registered query with its DuckDB oracle on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else v)
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf: str, run, sql: str, con=None) -> list[str]:
    """Differences as text; empty when names, row count and values agree."""
    con = con or connect(sf)
    df = run(spark, sf)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return [f"columns {sorted(got_names)} != {sorted(want_names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    return [f"{x} != {y}" for x, y in zip(a, b) if x != y][:3]
