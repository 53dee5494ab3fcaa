"""Splits by time, kept as one column so that a single frame carries every part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.fixed_values import TRAIN_END, VALIDATION_START
from gridweave.functions.text import Expr, add
from gridweave.operators.quality import DataQualityError


def at(moment: str) -> Expr:
    return f"TIMESTAMP_NTZ'{moment}'"


def train_test(df: DataFrame, train_end: str = TRAIN_END, ts: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Strictly before, and on or after; the filters reach the scan."""
    return df.filter(f"{ts} < {at(train_end)}"), df.filter(f"{ts} >= {at(train_end)}")


def add_split(df: DataFrame, train_end: str = TRAIN_END, ts: str = "datetime") -> DataFrame:
    return add(df, {"split": f"CASE WHEN {ts} < {at(train_end)} THEN 'train' ELSE 'test' END"})


def add_fit_split(
    df: DataFrame, validation_start: str = VALIDATION_START, train_end: str = TRAIN_END, ts: str = "datetime"
) -> DataFrame:
    """train_fit before ``validation_start``, validation before ``train_end``, then test."""
    train = f"{ts} < {at(train_end)}"
    part = (
        f"CASE WHEN {train} AND {ts} < {at(validation_start)} THEN 'train_fit' "
        f"WHEN {train} THEN 'validation' ELSE 'test' END"
    )
    return add(df, {"split": part})


def subset(df: DataFrame, condition: Expr) -> DataFrame:
    """Keys, features and targets live in one frame, so one filter keeps them aligned."""
    return df.filter(condition)


def split_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def require_rows(counts: dict[str, int], names: tuple[str, ...]) -> dict[str, int]:
    """Fails when one of the splits has no rows."""
    empty = [n for n in names if not counts.get(n)]
    if empty:
        raise DataQualityError(f"empty split: {', '.join(empty)}")
    return counts


def require_splits(df: DataFrame, names: tuple[str, ...]) -> dict[str, int]:
    """Row counts per split; fails when one is empty."""
    return require_rows({r["split"]: r["rows"] for r in split_rows(df).collect()}, names)
