"""Prediction frames, metric sets, comparisons and the run payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.fixed_values import PLOT_DAYS
from gridweave.functions.errors import METRICS, ape, metric_aggregates
from gridweave.functions.guards import difference, missing_or_not_finite
from gridweave.functions.text import Expr, add, col, quote, select, struct
from gridweave.operators.quality import DataQualityError
from gridweave.operators.series import Series, first_rows, first_series
from gridweave.operators.summary import grouped

BASELINE = "baseline_lag24_kwh"
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"
PROFILE_SERIES = Series(keys=("profile_code",))


def prediction_frame(
    df: DataFrame, actual: Expr, predicted: Expr, baseline: Expr, keys: list[str] | None = None, text_time: bool = True
) -> DataFrame:
    """Keys, actual, predicted, baseline, error, absolute error and percentage error."""
    time = f"date_format(datetime, {quote(TIME_TEXT)})" if text_time else "datetime"
    values = {"datetime": time, "actual_kwh": actual, "predicted_kwh": predicted, BASELINE: baseline}
    base = df.selectExpr(*select(keys or ["profile_code", "profile_name"], values))
    return add(
        base,
        {
            "error_kwh": "actual_kwh - predicted_kwh",
            "abs_error_kwh": "abs(actual_kwh - predicted_kwh)",
            "ape": ape("actual_kwh", "predicted_kwh"),
        },
    )


def metrics(df: DataFrame, actual: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    return grouped(df, by or [], metric_aggregates(col(actual), col(prediction)))


def metric_pair(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Model and baseline metrics side by side, and their differences, from one pass."""
    model = metric_aggregates("actual_kwh", "predicted_kwh")
    base = metric_aggregates("actual_kwh", BASELINE)
    both = {f"model_{m}": model[m] for m in METRICS} | {f"lag24_{m}": base[m] for m in METRICS}
    deltas = {f"{m}_delta_model_minus_lag24": difference(f"model_{m}", f"lag24_{m}") for m in METRICS}
    return add(grouped(df, by or [], both), deltas)


def compare_metrics(metric_rows: DataFrame, model: str, baseline: str, on: list[str]) -> DataFrame:
    """Differences between two models of a metrics table; absent values stay null.

    One row per run and model: the conditional aggregate lines the two up without a self join.
    """
    sides = {
        f"_{side}_{m}": f"max(CASE WHEN model = {quote(name)} THEN {m} END)"
        for side, name in (("a", model), ("b", baseline))
        for m in METRICS
    }
    lined_up = grouped(metric_rows, on, {"_has": f"count_if(model = {quote(model)})", **sides}).filter("_has > 0")
    return lined_up.selectExpr(*select(on, {f"{m}_delta": difference(f"_a_{m}", f"_b_{m}") for m in METRICS}))


def baseline_gaps(df: DataFrame, baseline: str = BASELINE) -> DataFrame:
    return df.selectExpr("count(*) AS rows", f"count_if({missing_or_not_finite(col(baseline))}) AS missing_count")


def gaps(columns: tuple[str, ...]) -> dict[str, Expr]:
    """Missing, NaN or infinite values of every column, as aggregates."""
    return {c: f"count_if({missing_or_not_finite(col(c))})" for c in columns}


def require_none(found: dict[str, int], what: str) -> None:
    for column, count in found.items():
        if count:
            raise DataQualityError(f"{what}: {count} missing or non-finite values in {column}")


def require_complete(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    """Fails when any value is missing, NaN or infinite; one pass for all columns."""
    require_none(df.selectExpr(*select([], gaps(columns))).first().asDict(), what)


def plot_window(
    predictions: DataFrame, profile: str | None = None, days: int = PLOT_DAYS, series: Series = PROFILE_SERIES
) -> DataFrame:
    """First ``days`` * 24 rows of one profile; the first one in key order when none is named."""
    key = series.keys[0]
    if profile is None:
        chosen = predictions.filter(F.col(key) == first_series(predictions, series).scalar())
    else:
        chosen = predictions.filter(f"string({col(key)}) = {quote(profile)}")
    return chosen.orderBy(series.time).limit(int(days * 24))


def plot_windows(predictions: DataFrame, days: int = PLOT_DAYS, series: Series = PROFILE_SERIES) -> DataFrame:
    """The same window for every series at once."""
    return first_rows(predictions, series, int(days * 24))


def payload(
    predictions: DataFrame,
    *,
    run_id: str,
    horizon: str,
    feature_set: str,
    target: str,
    source: str = "raw_frame.load_lag_24",
    series: str = "profile_code",
) -> DataFrame:
    """Nested one-row payload: test statistics, both metric sets and their differences."""
    iso = quote("yyyy-MM-dd'T'HH:mm:ss")
    flat = {
        "_rows": "count(*)",
        "_start": f"date_format(min(datetime), {iso})",
        "_end": f"date_format(max(datetime), {iso})",
        "_profiles": f"count(DISTINCT {col(series)})",
        "_min": "min(actual_kwh)",
        "_max": "max(actual_kwh)",
        "_mean": "avg(actual_kwh)",
        "_std": "stddev_pop(actual_kwh)",
        "_gaps": f"count_if({missing_or_not_finite(BASELINE)})",
        **{f"_m_{m}": e for m, e in metric_aggregates("actual_kwh", "predicted_kwh").items()},
        **{f"_b_{m}": e for m, e in metric_aggregates("actual_kwh", BASELINE).items()},
    }
    test = {
        "rows": "_rows",
        "start": "_start",
        "end": "_end",
        "profile_count": "_profiles",
        "target_stats_kwh": struct({n: f"_{n}" for n in ("min", "max", "mean", "std")}),
    }
    lag24 = {
        **{m: f"_b_{m}" for m in METRICS},
        "column": quote(BASELINE),
        "source": quote(source),
        "missing_count": "_gaps",
        "independent_from_model_output": "true",
    }
    return grouped(predictions, [], flat).selectExpr(
        *select(
            [],
            {
                "run_id": quote(run_id),
                "horizon": quote(horizon),
                "feature_set": quote(feature_set),
                "target_column": quote(target),
                "unit": quote("kWh"),
                "test": struct(test),
                "model": struct({m: f"_m_{m}" for m in METRICS}),
                "baselines": struct({"lag24": struct(lag24)}),
                "comparison": struct(
                    {f"{m}_delta_model_minus_lag24": difference(f"_m_{m}", f"_b_{m}") for m in METRICS}
                ),
            },
        )
    )
