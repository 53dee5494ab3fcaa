"""Min-max scaling with statistics from the training part only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridweave.fixed_values import FEATURE_CLIP, META_COLUMNS, TARGET_CLIP
from gridweave.functions.guards import clip
from gridweave.functions.text import Expr, aggregate_rows, col, constant_rows, num, quote, select
from gridweave.operators.quality import DataQualityError


@dataclass(frozen=True)
class ColumnStats:
    lo: float
    hi: float
    span: float


Stats = dict[str, ColumnStats]


def minmax_stats(train: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (column, min, max, range) from one aggregate; a constant column gets range 1.

    NaN is missing, as null is.
    """
    rows = []
    for c in columns:
        value = f"nullif(double({col(c)}), double('NaN'))"
        lo, hi = f"min({value})", f"max({value})"
        rows.append(
            {
                "column": quote(c),
                "min": lo,
                "max": hi,
                "range": f"CASE WHEN {hi} = {lo} THEN 1.0D ELSE {hi} - {lo} END",
            }
        )
    return aggregate_rows(train, rows)


def collect_stats(stats: DataFrame) -> Stats:
    """One small row per column, needed as literals in the scaling projection; all must be finite."""
    rows = stats.collect()
    bad = [r["column"] for r in rows if not all(v is None or math.isfinite(v) for v in (r["min"], r["max"], r["range"]))]
    if bad:
        raise DataQualityError(f"scaler statistics are not finite: {bad}")
    return {r["column"]: ColumnStats(r["min"], r["max"], r["range"]) for r in rows}


def stats_table(spark: SparkSession, stats: Stats) -> DataFrame:
    return constant_rows(
        spark,
        [{"column": quote(c), "min": num(s.lo), "max": num(s.hi), "range": num(s.span)} for c, s in stats.items()],
    )


def _of(stats: Stats, column: str) -> ColumnStats:
    if column not in stats or stats[column].span is None:
        raise DataQualityError(f"missing scaler statistics for {column!r}")
    return stats[column]


def scaled(column: str, stats: Stats, limits: tuple[float, float] = FEATURE_CLIP) -> Expr:
    s = _of(stats, column)
    return clip(f"(double({col(column)}) - {num(s.lo)}) / {num(s.span)}", *limits)


def scaled_target(target: str, stats: Stats) -> Expr:
    return scaled(target, stats, TARGET_CLIP)


def unscaled(e: Expr, column: str, stats: Stats) -> Expr:
    """Back to raw units; the same for features and targets."""
    s = _of(stats, column)
    return f"({e} * {num(s.span)} + {num(s.lo)})"


def raw_frame(df: DataFrame, features: list[str], target: str, extra: list[str] | None = None) -> DataFrame:
    return df.select(*META_COLUMNS, *features, target, *(extra or []))


def scaled_frame(
    df: DataFrame, features: list[str], target: str, stats: Stats, extra: dict[str, Expr] | None = None
) -> DataFrame:
    """Scaled features, the raw target, and the scaled target beside it: one projection."""
    exprs = {c: scaled(c, stats) for c in features}
    exprs[target] = col(target)
    exprs[f"{target}_scaled"] = scaled_target(target, stats)
    return df.selectExpr(*select(META_COLUMNS, {**exprs, **(extra or {})}))


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """What remains after dropping keys and targets."""
    dropped = {*META_COLUMNS, target, f"{target}_scaled", "split"}
    return [c for c in df.columns if c not in dropped]
