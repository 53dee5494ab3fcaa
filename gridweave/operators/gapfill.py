"""Linear gap filling by row position, and the dense grid it usually runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import Expr, add, col, cols, window
from gridweave.operators.series import BUCKET_STEPS, PLAIN_ROWS, Series, cell, with_positions

FROM_START = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE_THIS = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
STEP_INTERVAL = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def dense_grid(panel: DataFrame, series: Series) -> DataFrame:
    """One row per series and step between the first and last time of that series.

    One aggregate gives every series its own span, so a short-lived series stays short.
    """
    spans = panel.groupBy(*series.keys).agg(F.min(series.time).alias("_lo"), F.max(series.time).alias("_hi"))
    steps = F.sequence("_lo", "_hi", F.expr(STEP_INTERVAL[series.step]))
    grid = spans.where("_lo IS NOT NULL").select(*series.keys, F.explode(steps).alias(series.time))
    # one struct as the join key: a null series key matches itself
    key = f"struct({cols([*series.keys, series.time])}) AS _g"
    values = [c for c in panel.columns if c not in (*series.keys, series.time)]
    return grid.selectExpr("*", key).join(panel.selectExpr(key, *map(col, values)), "_g", "left").drop("_g")


def present(c: str) -> Expr:
    return f"({col(c)} IS NOT NULL AND NOT isnan(double({col(c)})))"


def _known(c: str) -> Expr:
    """(position, value) of a filled row, null otherwise; NaN is no value."""
    return f"CASE WHEN {present(c)} THEN named_struct('pos', _pos, 'val', double({col(c)})) END"


def _between(c: str) -> Expr:
    """The value itself, or the line between its two neighbours, or the only neighbour."""
    b, a = col(f"_b_{c}"), col(f"_a_{c}")
    inner = f"{b}.val + (_pos - {b}.pos) * ({a}.val - {b}.val) / double({a}.pos - {b}.pos)"
    return (
        f"CASE WHEN {present(c)} THEN double({col(c)}) "
        f"WHEN {b} IS NULL THEN {a}.val WHEN {a} IS NULL THEN {b}.val ELSE {inner} END"
    )


def interpolate(
    df: DataFrame,
    series: Series,
    columns: list[str],
    *,
    bound: int | None = None,
    bucket_steps: int = BUCKET_STEPS,
) -> DataFrame:
    """Fill nulls on the straight line between the nearest known rows; edges take the nearest value.

    Both directions use frames that start at the first row (the second one over the reversed
    order): a frame that ends at the last row would be re-read for every row.
    """
    kept, keys = df.columns, list(series.keys)
    if bound is not None and bound <= PLAIN_ROWS:
        positioned = add(df, {"_pos": f"bigint(row_number() OVER {window(keys, col(series.time))})"})
        parts, carried = keys, False
    else:
        positioned = _with_neighbours(with_positions(df, series, bucket_steps), keys, columns)
        parts, carried = ["_cell"], True

    up = window(parts, "_pos", FROM_START)
    down = window(parts, "_pos DESC", FROM_START)
    sides = {}
    for c in columns:
        before = f"last({_known(c)}, true) OVER {up}"
        after = f"last({_known(c)}, true) OVER {down}"
        sides[f"_b_{c}"] = f"coalesce({before}, {col(f'_prev_{c}')})" if carried else before
        sides[f"_a_{c}"] = f"coalesce({after}, {col(f'_next_{c}')})" if carried else after
    staged = add(positioned, sides)
    return staged.selectExpr(*[f"{_between(c)} AS {col(c)}" if c in columns else col(c) for c in kept])


def _with_neighbours(positioned: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Joins to every bucket the last known value before it and the first known value after it.

    The per-series windows see one summary row per bucket.
    """
    edges = positioned.groupBy(*keys, "_bucket").agg(
        *[F.expr(f"max({_known(c)})").alias(f"_last_{c}") for c in columns],
        *[F.expr(f"min({_known(c)})").alias(f"_first_{c}") for c in columns],
    )
    past, future = window(keys, "_bucket", BEFORE_THIS), window(keys, "_bucket DESC", BEFORE_THIS)
    neighbours = edges.selectExpr(
        f"{cell(keys)} AS _cell",
        *[f"last({col(f'_last_{c}')}, true) OVER {past} AS {col(f'_prev_{c}')}" for c in columns],
        *[f"last({col(f'_first_{c}')}, true) OVER {future} AS {col(f'_next_{c}')}" for c in columns],
    )
    return positioned.join(neighbours, "_cell")
