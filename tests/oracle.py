"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    out = pd.DataFrame(index=df.index)
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            out[c] = s.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(s):
            out[c] = [("null" if pd.isna(v) else repr(float(v))) for v in s]
        else:
            out[c] = ["null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v) for v in s]
    return sorted(map(tuple, out.itertuples(index=False)))


def differences(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str:
    """Empty when both hold the same columns and rows."""
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} != {len(duck_df)}"
    left, right = canonical(spark_df), canonical(duck_df)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if not bad:
        return ""
    names = sorted(spark_df.columns)
    a, b = bad[0]
    first = {n: (x, y) for n, x, y in zip(names, a, b) if x != y}
    return f"{len(bad)} of {len(left)} rows differ, first: {first}"
