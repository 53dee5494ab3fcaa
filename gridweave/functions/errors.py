"""Forecast errors."""

from __future__ import annotations

from gridweave.fixed_values import METRIC_EPS
from gridweave.functions.text import Expr, num

METRICS = ("mae", "rmse", "mape", "r2")


def ape(actual: Expr, prediction: Expr) -> Expr:
    """Absolute percentage error, in percent, guarded near zero; null when either value is."""
    return f"abs({actual} - {prediction}) / greatest(abs({actual}), {num(METRIC_EPS)}) * 100.0D"


def metric_aggregates(actual: Expr, prediction: Expr) -> dict[str, Expr]:
    """MAE, RMSE, MAPE and R2 as aggregates of one pass, over the rows that have both values."""
    error = f"({actual} - {prediction})"
    scored = f"CASE WHEN {prediction} IS NOT NULL THEN {actual} END"
    total = f"var_pop({scored}) * count({scored})"
    return {
        "mae": f"avg(abs({error}))",
        "rmse": f"sqrt(avg({error} * {error}))",
        "mape": f"avg({ape(actual, prediction)})",
        "r2": f"CASE WHEN {total} > {num(METRIC_EPS)} THEN 1.0D - sum({error} * {error}) / ({total}) ELSE 0.0D END",
    }
