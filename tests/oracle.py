"""Holds a registered query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def canonical(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "[" + ",".join(map(canonical, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def compare(spark, query, sql, data=DATA):
    df = query(spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    theirs = con.sql(sql)
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(tuple(canonical(r[k]) for k in at) for r in theirs.fetchall())
