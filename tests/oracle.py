"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEXTQUARRY_DATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    frame = frame[sorted(frame.columns)]
    clean = [tuple(None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else round(float(v), 5) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, (str, bool)) else v for v in r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(clean, key=repr)


def difference(spark_frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if both give the same rows."""
    names, ours = rows(spark_frame.toPandas())
    other, theirs = rows(con.execute(sql).df())
    if names != other:
        return f"columns {names} against {other}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}; {list(set(ours) ^ set(theirs))[:4]}"
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(odd)} rows differ: {odd[:3]}" if odd else ""
