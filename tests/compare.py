"""Spark rows against DuckDB rows, in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return None if v is None else str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_cell(r[i])) for i in order) for r in rows)


def same(df, sql, folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, want)
