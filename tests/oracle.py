"""Run registered queries in Spark and their SQL in DuckDB over the same tables, and compare rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def _key(row) -> tuple:
    return tuple((x is None, str(type(x).__name__ in ("int", "float")), str(x)) for x in row)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(([_value(x) for x in r] for r in df.select(*[df[c] for c in names]).collect()), key=_key)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(c) for c in names]
    theirs = sorted(([_value(r[i]) for i in at] for r in cur.fetchall()), key=_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x))):
                return f"{a} and {b}"
    return ""
