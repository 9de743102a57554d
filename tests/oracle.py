"""Comparing a query with its SQL, as sorted rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(str(tuple(norm(r[c]) for c in columns)) for r in df.collect())


def expected(c, sql):
    rel = c.sql(sql)
    names = list(rel.columns)
    columns = sorted(names)
    return columns, sorted(str(tuple(norm(dict(zip(names, r))[k]) for k in columns)) for r in rel.fetchall())
