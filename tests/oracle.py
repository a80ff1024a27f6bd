"""Holds a query's rows against DuckDB's for the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([_cell(x) for x in v])
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return str(v)


def normal(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False, name=None))
