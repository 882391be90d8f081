"""Comparison of a query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def duck_rows(sql: str, folder: str, columns: list[str]) -> Counter:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    return Counter(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def assert_same(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    want = duck_rows(sql, folder, columns)
    assert got == want, f"only here {list((got - want).items())[:2]}, only in SQL {list((want - got).items())[:2]}"
