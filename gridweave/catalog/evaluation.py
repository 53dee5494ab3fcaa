"""Persistence forecast, metrics, comparisons and the run payload.

The mean of the last 24 readings stands in for a model, so that SQL can check every number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.catalog.sql import r
from gridweave.functions.errors import METRICS
from gridweave.functions.nested import flatten
from gridweave.functions.text import add, quote
from gridweave.operators import evaluate
from gridweave.operators.baselines import persistence
from gridweave.operators.evaluate import BASELINE
from gridweave.operators.quality import finite_report
from gridweave.operators.scaling import scaled
from gridweave.operators.splits import add_fit_split, train_test
from gridweave.operators.summary import histogram

FRAME = ["actual_kwh", "predicted_kwh", BASELINE, "error_kwh", "abs_error_kwh", "ape"]
MODEL = "load_rolling_24"


def _frame(spark: SparkSession, sf: str, target: str = "target_1h", text_time: bool = True) -> DataFrame:
    """Prediction frame of the test rows of the wide table."""
    _, test = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    return evaluate.prediction_frame(test, target, MODEL, persistence(test), text_time=text_time)


def lag24_split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence forecast per series and split: panel, calendar, lags, split, metrics."""
    rows = add_fit_split(i.panel_lags(spark, sf), i.VALIDATION_START, i.TRAIN_END)
    scored = evaluate.metrics(rows, "target_24h", "load_lag_24", ["series_id", "split"])
    return i.rounded(scored, list(METRICS))


def baseline_lag24(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(_frame(spark, sf), FRAME)


def baseline_from_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """The persistence forecast when only the scaled lag is left."""
    p = i.prepared(spark, sf)
    _, test = train_test(p.rows, i.TRAIN_END)
    only_scaled = add(test, {"load_lag_24_scaled": scaled("load_lag_24", p.stats)}).drop("load_lag_24")
    back = add(only_scaled, {"baseline": persistence(only_scaled, p.stats)})
    return i.rounded(back.select("profile_code", "datetime", "baseline"), ["baseline"])


def baseline_complete(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.baseline_gaps(_frame(spark, sf))


def prediction_finite(spark: SparkSession, sf: str) -> DataFrame:
    return finite_report(_frame(spark, sf), ["actual_kwh", "predicted_kwh", BASELINE])


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = evaluate.metrics(_frame(spark, sf), "actual_kwh", "predicted_kwh", ["profile_name"])
    return i.rounded(scored, list(METRICS))


def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    pair = evaluate.metric_pair(_frame(spark, sf, "target_24h"))
    return i.rounded(pair, pair.columns)


def _model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of two forecasts for both horizons, one row each."""
    _, test = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    entries = ", ".join(
        f"named_struct('horizon', '{h}', 'model', {quote(m)}, 'actual', target_{h}, 'prediction', {c})"
        for h in ("1h", "24h")
        for m, c in (("rolling", MODEL), ("lag24", "load_lag_24"))
    )
    long = test.selectExpr(f"inline(array({entries}))")
    return evaluate.metrics(long, "actual", "prediction", ["horizon", "model"])


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    compared = evaluate.compare_metrics(_model_metrics(spark, sf), "rolling", "lag24", ["horizon"])
    return i.rounded(compared, [f"{m}_delta" for m in METRICS])


def metrics_records(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(_model_metrics(spark, sf), list(METRICS))


def residual_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(histogram(_frame(spark, sf), "error_kwh"), ["bin_start", "bin_end"])


def actual_vs_predicted_window(spark: SparkSession, sf: str) -> DataFrame:
    """First two days of one profile's predictions."""
    window = evaluate.plot_window(_frame(spark, sf), days=2)
    return i.rounded(window.select("datetime", "profile_code", "actual_kwh", "predicted_kwh", BASELINE), ["predicted_kwh"])


def run_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The nested payload, flattened to dotted columns."""
    nested = evaluate.payload(
        _frame(spark, sf, "target_24h", text_time=False), run_id="check", horizon="24h", feature_set="core", target="target_24h"
    )
    flat = flatten(nested)
    doubles = [c for c, t in flat.dtypes if t == "double"]
    return i.rounded(flat, doubles)


QUERIES = {
    f.__name__: f
    for f in (
        lag24_split_metrics, baseline_lag24, baseline_from_scaled, baseline_complete, prediction_finite,
        regression_metrics, metric_deltas, model_comparison, metrics_records, residual_histogram,
        actual_vs_predicted_window, run_payload,
    )
}


def metrics_sql(actual: str, prediction: str) -> dict[str, str]:
    e = f"({actual} - {prediction})"
    return {
        "mae": f"avg(abs({e}))",
        "rmse": f"sqrt(avg({e} * {e}))",
        "mape": f"avg(abs({e}) / greatest(abs({actual}), 1e-8) * 1e2)",
        "r2": f"CASE WHEN var_pop({actual}) * count(*) > 1e-8 THEN 1 - sum({e} * {e}) / (var_pop({actual}) * count(*)) ELSE 0 END",
    }


def _metric_list(actual: str, prediction: str, prefix: str = "") -> str:
    return ", ".join(f"{r(e)} AS {prefix}{m}" for m, e in metrics_sql(actual, prediction).items())


def _test(target: str) -> str:
    return q.wide_plus(
        q.splits(),
        f"""f AS (SELECT strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, datetime AS moment, profile_code, profile_name,
         {target} AS actual_kwh, load_rolling_24 AS predicted_kwh, load_lag_24 AS {BASELINE} FROM rows1 WHERE split = 'test')""",
    )


_BOTH = " UNION ALL ".join(
    f"SELECT '{h}' AS horizon, '{m}' AS model, target_{h} AS actual, {c} AS prediction FROM rows1 WHERE split = 'test'"
    for h in ("1h", "24h")
    for m, c in (("rolling", MODEL), ("lag24", "load_lag_24"))
)
_LONG = q.wide_plus(
    q.splits(),
    f"l AS ({_BOTH})",
    "m AS (SELECT horizon, model, " + ", ".join(f"{e} AS {m}" for m, e in metrics_sql("actual", "prediction").items()) + " FROM l GROUP BY 1, 2)",
)
_ERROR = "actual_kwh - predicted_kwh"
_MODEL_SQL, _LAG_SQL = metrics_sql("actual_kwh", "predicted_kwh"), metrics_sql("actual_kwh", BASELINE)

ORACLE = {
    "lag24_split_metrics": q.with_(q.EV, q.PANEL, q.lag_block("panel", "lags", "series_id"), q.splits("lags"))
    + f"SELECT series_id, fit_split AS split, {_metric_list('target_24h', 'load_lag_24')} FROM rows1 GROUP BY 1, 2",
    "baseline_lag24": _test("target_1h")
    + f"""SELECT datetime, profile_code, profile_name, actual_kwh, {r("predicted_kwh")} AS predicted_kwh, {BASELINE},
       {r(_ERROR)} AS error_kwh, {r(f"abs({_ERROR})")} AS abs_error_kwh, {r(f"abs({_ERROR}) / greatest(abs(actual_kwh), 1e-8) * 1e2")} AS ape FROM f""",
    "baseline_from_scaled": q.wide_plus(q.splits(), q.stats(["load_lag_24"]))
    + f"""SELECT profile_code, datetime, {r(q.scaled("load_lag_24") + " * span_load_lag_24 + lo_load_lag_24")} AS baseline
       FROM rows1, st WHERE split = 'test'""",
    "baseline_complete": _test("target_1h") + f"SELECT count(*) AS rows, count(*) - count({BASELINE}) AS missing_count FROM f",
    "prediction_finite": _test("target_1h")
    + " UNION ALL ".join(
        f"""SELECT 'not_finite' AS "check", '{c}' AS "column", count(*) - count({c}) AS violations FROM f"""
        for c in ("actual_kwh", "predicted_kwh", BASELINE)
    ),
    "regression_metrics": _test("target_1h") + f"SELECT profile_name, {_metric_list('actual_kwh', 'predicted_kwh')} FROM f GROUP BY 1",
    "metric_deltas": _test("target_24h")
    + f"SELECT {_metric_list('actual_kwh', 'predicted_kwh', 'model_')}, {_metric_list('actual_kwh', BASELINE, 'lag24_')}, "
    + ", ".join(f"{r(f'{_MODEL_SQL[m]} - ({_LAG_SQL[m]})' if m != 'r2' else f'({_MODEL_SQL[m]}) - ({_LAG_SQL[m]})')} AS {m}_delta_model_minus_lag24" for m in METRICS)
    + " FROM f",
    "model_comparison": _LONG
    + "SELECT a.horizon, "
    + ", ".join(f"{r(f'a.{m} - b.{m}')} AS {m}_delta" for m in METRICS)
    + " FROM m a JOIN m b ON a.horizon = b.horizon AND a.model = 'rolling' AND b.model = 'lag24'",
    "metrics_records": _LONG + "SELECT horizon, model, " + ", ".join(f"{r(m)} AS {m}" for m in METRICS) + " FROM m",
    "residual_histogram": _test("target_1h")
    + f""", e AS (SELECT {_ERROR} AS v FROM f), lim AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
binned AS (SELECT CAST(least(floor(50 * (v - lo) / (hi - lo)), 49) AS INTEGER) AS bin, lo, hi FROM e, lim)
SELECT bin, {r("lo + bin * ((hi - lo) / 5e1)")} AS bin_start, {r("lo + (bin + 1) * ((hi - lo) / 5e1)")} AS bin_end, count(*) AS rows
FROM binned GROUP BY bin, lo, hi""",
    "actual_vs_predicted_window": _test("target_1h")
    + f"""SELECT datetime, profile_code, actual_kwh, {r("predicted_kwh")} AS predicted_kwh, {BASELINE} FROM f
       WHERE profile_code = (SELECT min(profile_code) FROM f) ORDER BY datetime LIMIT 48""",
    "run_payload": _test("target_24h")
    + f"""SELECT 'check' AS run_id, '24h' AS horizon, 'core' AS feature_set, 'target_24h' AS target_column, 'kWh' AS unit,
       count(*) AS "test.rows", strftime(min(moment), '%Y-%m-%dT%H:%M:%S') AS "test.start", strftime(max(moment), '%Y-%m-%dT%H:%M:%S') AS "test.end",
       count(DISTINCT profile_code) AS "test.profile_count", min(actual_kwh) AS "test.target_stats_kwh.min",
       max(actual_kwh) AS "test.target_stats_kwh.max", {r("avg(actual_kwh)")} AS "test.target_stats_kwh.mean",
       {r("stddev_pop(actual_kwh)")} AS "test.target_stats_kwh.std", """
    + ", ".join(f'{r(e)} AS "model.{m}"' for m, e in _MODEL_SQL.items())
    + ", "
    + ", ".join(f'{r(e)} AS "baselines.lag24.{m}"' for m, e in _LAG_SQL.items())
    + f""", '{BASELINE}' AS "baselines.lag24.column", 'raw_frame.load_lag_24' AS "baselines.lag24.source",
       count(*) - count({BASELINE}) AS "baselines.lag24.missing_count", true AS "baselines.lag24.independent_from_model_output", """
    + ", ".join(f'{r(f"({_MODEL_SQL[m]}) - ({_LAG_SQL[m]})")} AS "comparison.{m}_delta_model_minus_lag24"' for m in METRICS)
    + " FROM f",
}
