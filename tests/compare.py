"""Rows of a query against those of its SQL, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(" ")
    return "null" if v is None else str(v)


def both(query, sql: str, spark, sf_dir: str) -> tuple[list, list]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    cursor = connect(sf_dir).execute(sql)
    at = [c[0] for c in cursor.description]
    assert sorted(at) == names
    return got, sorted([plain(r[at.index(c)]) for c in names] for r in cursor.fetchall())
