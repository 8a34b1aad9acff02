"""Spark rows against DuckDB's, as multisets with floats rounded."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return round(x, 5)
    if hasattr(x, "tzinfo"):
        return str(x)[:19]
    return float(round(x, 5)) if type(x).__name__ == "Decimal" else x


def rows(names, values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in values)


def difference(spark_df, con, sql: str):
    got = rows(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(names) == sorted(spark_df.columns), (names, spark_df.columns)
    return list((got - want).items())[:3], list((want - got).items())[:3], sum(want.values())
