"""Rows of Spark and of DuckDB in one form."""

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if isinstance(v, str):
        return v
    return round(float(v), 6) + 0.0


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)
