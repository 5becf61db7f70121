"""Comparison of a Spark result with a DuckDB result: column names, row count and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def _plain(value):
    if value is None or str(value) in ("<NA>", "NaT"):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return "null" if math.isnan(float(value)) else f"{float(value):.9g}"
    return str(value)


def rows(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False))
