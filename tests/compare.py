"""Rows of a query and of its SQL, made comparable."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    return str(pd.Timestamp(v).tz_localize(None)) if hasattr(v, "isoformat") else str(v)


def canon(df):
    df = df[sorted(df.columns)]
    return sorted(df.columns), sorted("|".join(map(_value, row)) for row in df.itertuples(index=False))
