"""Runs queries on Spark and their SQL on DuckDB over the same tables, and compares columns and rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, folder: str, query, sql: str) -> str | None:
    """None where both agree, else what differs."""
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(folder).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else None
