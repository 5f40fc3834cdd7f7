"""Rows of a query against rows of its SQL, types and order aside."""

import decimal
import glob
import os

import duckdb
import pandas as pd


def connect(d):
    con = duckdb.connect()
    for f in glob.glob(d + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.5f}" if float(x) != int(x) else str(int(x))
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))
