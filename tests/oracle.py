"""Runs a query on Spark and its SQL on DuckDB and compares the rows exactly."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else a text that shows the difference."""
    df = query(spark, sf_dir)
    left_columns, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_columns, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if left != right:
        a, b = list((left - right).items())[:3], list((right - left).items())[:3]
        return (
            f"{sum(left.values())} vs {sum(right.values())} rows; "
            f"{sum((left - right).values())} differ\n spark  {a}\n duckdb {b}\n {left_columns}"
        )
    return None
