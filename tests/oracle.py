"""Runs a query and its SQL over the same tables and compares names, and values without order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf, f, sql):
    df = f(spark, sf)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    return {c: (t, kinds[c]) for c, t in df.dtypes}
