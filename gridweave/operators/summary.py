"""Summaries and profiling tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.fixed_values import HISTOGRAM_BINS
from gridweave.functions.text import Expr, aggregate_rows, col, cols, num, quote, select, table
from gridweave.operators.moments import correlations
from gridweave.operators.quantiles import BUFFER_ROWS, exact_quantiles, profile
from gridweave.session import stored

QUARTILES = [0.25, 0.5, 0.75]
# HyperLogLog can never estimate more than this from five distinct values or fewer
FEW_DISTINCT, FEW_ESTIMATE = 5, 16
#: Base-two logarithm of the slots of a mergeable sketch; 1.6 % standard error
SKETCH_SIZE = 12


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def grouped(df: DataFrame, keys: list[str], aggregates: dict[str, Expr]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])


def split_summary(df: DataFrame, target: str, horizon: str, ts: str = "datetime") -> DataFrame:
    """Rows, time span and target statistics for all rows and each split, in one pass."""
    aggregates = {
        "_all": "grouping(split)",
        "rows": "count(*)",
        "start_datetime": f"min({ts})",
        "end_datetime": f"max({ts})",
        "target_mean": f"avg({target})",
        "target_std": f"stddev_samp({target})",
        "target_min": f"min({target})",
        "target_max": f"max({target})",
    }
    rolled = df.rollup("split").agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
    named = {
        "horizon": quote(horizon),
        "target_column": quote(target),
        "split": "CASE WHEN _all = 1 THEN 'all' ELSE split END",
    }
    return rolled.selectExpr(*select([], named), *[n for n in aggregates if n != "_all"])


def target_stats(df: DataFrame, target: str, ts: str = "datetime", series: str = "profile_code") -> DataFrame:
    t = col(target)
    return df.selectExpr(
        "count(*) AS rows",
        f"min({ts}) AS start",
        f"max({ts}) AS end",
        f"count(DISTINCT {col(series)}) AS profile_count",
        f"min({t}) AS min",
        f"max({t}) AS max",
        f"avg({t}) AS mean",
        f"stddev_pop({t}) AS std",
    )


def describe(
    df: DataFrame, columns: list[str], keys: list[str] | None = None, buffer_rows: int = BUFFER_ROWS
) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column (and per key)."""
    keys = list(keys or [])
    moments = {"mean": "double(avg({}))", "std": "stddev_samp({})"}
    known = profile(df, columns, keys, moments)
    quartiles = exact_quantiles(df, columns, QUARTILES, keys, buffer_rows, known=known)
    # one struct as the join key: null keys match each other
    key = f"struct({cols([*keys, 'column'])}) AS _g"
    joined = known.selectExpr("*", key).join(quartiles.selectExpr(key, "quantiles"), "_g", "left")
    picked = {"count": "n", "mean": "mean", "std": "std", "min": "low"}
    quarters = {"p25": "quantiles[0]", "p50": "quantiles[1]", "p75": "quantiles[2]", "max": "high"}
    return joined.selectExpr(*select([*keys, "column"], {**picked, **quarters}))


def indicator_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.selectExpr(*select([], {c: f"avg({col(c)})" for c in columns}))


def group_mean(df: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(name or f"mean_{value}"))


def series_count(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Number of distinct keys; the estimate needs no shuffle of the keys."""
    count = f"approx_count_distinct({col(key)})" if approximate else f"count(DISTINCT {col(key)})"
    return df.selectExpr(f"{count} AS series")


def daily_sketches(df: DataFrame, key: str, ts: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(day, sketch) of the distinct keys, written: days are counted once and merged into any longer span later."""
    days = df.selectExpr(f"to_date({col(ts)}) AS day", col(key)).groupBy("day")
    return stored(days.agg(F.hll_sketch_agg(key, size).alias("sketch")), "daily-sketches")


def merged_count(sketches: DataFrame, span: Expr, name: str) -> DataFrame:
    """Estimated distinct keys of every span of days, from their sketches alone."""
    spans = sketches.selectExpr(f"{span} AS {col(name)}", "sketch").groupBy(name)
    return spans.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("series"))


def histogram(df: DataFrame, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins between min and max; the last bin includes its upper edge.

    The limits are two scalar subqueries over the same input, so no join and no driver round
    trip. A single repeated value gets the unit interval around it.
    """
    data = df.selectExpr(f"double({col(value)}) AS _v").filter("_v IS NOT NULL")
    half = "CASE WHEN min(_v) = max(_v) THEN 0.5D ELSE 0.0D END"
    lo = data.selectExpr(f"min(_v) - {half} AS lo").scalar()
    hi = data.selectExpr(f"max(_v) + {half} AS hi").scalar()
    limits = data.select("_v", lo.alias("_lo"), hi.alias("_hi"))
    binned = limits.selectExpr(
        "_lo", "_hi", f"int(least(width_bucket(_v, _lo, _hi, {bins}), {bins}) - 1) AS bin"
    )
    counts = binned.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("rows"))
    width = f"(_hi - _lo) / {num(bins)}"
    return counts.selectExpr(
        "bin", f"_lo + bin * {width} AS bin_start", f"_lo + (bin + 1) * {width} AS bin_end", "rows"
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, pairwise complete, in one pass: (x, y, r) rows."""
    return correlations(df, columns, columns)


def top_correlations(df: DataFrame, target: str, limit: int = 15) -> DataFrame:
    """The highest correlations with the target, itself included; undefined ones come last."""
    rows = correlations(df, numeric_columns(df), [target]).selectExpr("x AS `column`", "r")
    return rows.orderBy(F.desc_nulls_last("r"), "column").limit(limit)


def missing(column: str, kind: str) -> Expr:
    """Null, and NaN in floating columns."""
    return f"{col(column)} IS NULL" + (f" OR isnan({col(column)})" if kind in ("double", "float") else "")


def missing_report(df: DataFrame) -> DataFrame:
    return aggregate_rows(
        df, [{"column": quote(c), "missing": f"count_if({missing(c, kind)})"} for c, kind in df.dtypes]
    )


def shape_report(df: DataFrame) -> DataFrame:
    """The row count with position, name and type of every column."""
    entries = table(
        {"position": str(i), "column": quote(f.name), "type": quote(f.dataType.simpleString())}
        for i, f in enumerate(df.schema.fields)
    )
    return df.selectExpr("count(*) AS rows").selectExpr("rows", f"inline({entries})")


def low_cardinality_columns(df: DataFrame, limit: int = 15) -> list[str]:
    """Text columns and columns with at most five distinct values, in name order.

    An estimate in one pass rules out the wide columns; it cannot exceed ``FEW_ESTIMATE`` for
    five values or fewer, so nothing is missed. The rest is counted exactly.
    """
    text = set(text_columns(df))
    others = [c for c in df.columns if c not in text]
    if not others:
        return sorted(text)[:limit]
    estimate = df.selectExpr(*select([], {c: f"approx_count_distinct({col(c)})" for c in others})).first()
    candidates = [c for c in others if estimate[c] <= FEW_ESTIMATE]
    few = {c for c in candidates if estimate[c] == 0}
    if candidates:
        pairs = value_counts(df, candidates).filter("value IS NOT NULL")
        sizes = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n")).filter(f"n <= {FEW_DISTINCT}")
        few |= {r["column"] for r in sizes.collect()}
    return sorted(text | few)[:limit]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    entries = table({"column": quote(c), "value": f"string({col(c)})"} for c in columns)
    return df.selectExpr(f"inline({entries})").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def low_cardinality(df: DataFrame, limit: int = 15) -> DataFrame:
    """Values of the low-cardinality columns as rows, so a wide text column stays distributed."""
    return value_counts(df, low_cardinality_columns(df, limit))


def top_rows(df: DataFrame, value: str, tie: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(value), *tie).limit(n)


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def low_values(df: DataFrame, value: str, below: float = 1.0) -> DataFrame:
    v = col(value)
    return df.selectExpr(
        f"min({v}) AS actual_min", f"avg({v}) AS actual_mean", f"count_if({v} < {num(below)}) AS values_below"
    )
