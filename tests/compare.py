"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares their rows without order."""

import glob
import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(folder):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def same_rows(df, con, sql):
    relation = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
