"""Compares a query with its SQL, run by duckdb over the same files."""

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def assert_same(spark, folder, query, sql):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    mine = sorted((tuple(_plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert mine == theirs
