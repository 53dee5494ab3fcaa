"""Fitted models: baselines, model files, run records.

Metrics of a fit have no SQL form, so they are computed twice, by different expressions from different scoring
paths, and the queries return whether both agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.catalog import fits
from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.fixed_values import CORE_FEATURES, META_COLUMNS, RIDGE_ALPHA
from gridweave.functions.errors import METRICS
from gridweave.functions.text import col, put, quote, select, table
from gridweave.operators import baselines, estimators, fuzzy, tree_models
from gridweave.operators.scaling import collect_stats, feature_columns, minmax_stats, scaled, unscaled
from gridweave.operators.splits import add_split
from gridweave.plans import train
from gridweave.session import scratch_path, spread, stored
from gridweave.sources import files, models


def _baseline(spark: SparkSession, sf: str, name: str, dataset: str = "extended", horizon: str = "1h") -> DataFrame:
    """One model with its full parameters: test rows, and metrics that differ from a second computation."""
    fit = train.fit_baselines({horizon: i.prepared(spark, sf, horizon)}, (dataset,), (name,))[0]
    return _metric_checks([fit]).groupBy("dataset", "horizon", "model", "rows").agg(F.expr("count_if(NOT agrees)").alias("different"))


def _metric_checks(fits: list[train.BaselineFit]) -> DataFrame:
    """(dataset, horizon, model, rows, metric, agrees): the metrics of the written predictions against the
    same metrics from the models as Spark expressions, by other formulas."""
    spark = fits[0].scored.sparkSession
    path = scratch_path(spark, "baseline-predictions")
    frames, again = [], []
    for fit in fits:
        test = fit.scored.where("split = 'test'")
        key = {"dataset": quote(fit.dataset), "horizon": quote(fit.horizon), "model": quote(fit.name)}
        frames.append(test.selectExpr(*select(META_COLUMNS, {**key, "actual": col(fit.target), "prediction": "prediction"})))
        scored = tree_models.predicted(spread(test), fit.model.stages[-1], fit.features, "_p").selectExpr(f"double({col(fit.target)}) AS y", "_p AS p")
        # one model at a time: a query over all of them would hold the nodes of all
        again.append(stored(scored.selectExpr("y", "y - p AS e").selectExpr(*[f"{v} AS {k}" for k, v in key.items()], *_SECOND), "baseline-second"))
    files.write_model_predictions(reduce(DataFrame.unionByName, frames), path)
    written = spark.read.schema(frames[0].schema).parquet(path)
    metrics = baselines.score_models(written, ["dataset", "horizon", "model"])
    sink = scratch_path(spark, "baseline-metrics")
    files.write_model_metrics(metrics, sink)
    both = spark.read.schema(metrics.schema).parquet(sink).join(reduce(DataFrame.unionByName, again), ["dataset", "horizon", "model"])
    pairs = table({"metric": quote(m), "agrees": f"coalesce(abs({m} - {m}_2) <= 1e-9D * greatest(1D, abs({m})), false)"} for m in METRICS)
    return both.selectExpr("dataset", "horizon", "model", "rows", f"inline({pairs})")


_SECOND = (
    "count(*) AS rows", "sum(abs(e)) / count(*) AS mae_2", "pow(sum(e * e) / count(*), 0.5D) AS rmse_2",
    "100D * sum(abs(e / y)) / count(*) AS mape_2", "1D - sum(e * e) / regr_syy(y, y) AS r2_2",
)


def baseline_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline(spark, sf, "Linear Regression")


def baseline_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline(spark, sf, "Decision Tree")


def baseline_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline(spark, sf, "Random Forest", "core")


def baseline_boosted(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline(spark, sf, "Boosted Trees", "core")


def baseline_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison table of all sixteen fits, from written predictions and metrics: for every feature set,
    horizon, metric and model whether the value agrees with a second computation."""
    checked = _metric_checks(fits.all_fits(spark, sf))
    wide = checked.groupBy("dataset", "horizon", "metric").pivot("model", list(baselines.MODEL_NAMES)).agg(F.first("agrees"))
    return wide.join(checked.groupBy("dataset", "horizon", "metric").agg(F.min("rows").alias("rows")), ["dataset", "horizon", "metric"])


def baseline_predictions_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One prediction column per model beside the actual value, for both feature sets and horizons; shown as
    the number of models that have a usable prediction."""
    frames, found = [], fits.all_fits(spark, sf)
    for dataset, horizon in sorted({(f.dataset, f.horizon) for f in found}):
        group = [f for f in found if (f.dataset, f.horizon) == (dataset, horizon)]
        rows = group[0].scored.where("split = 'test'").drop("prediction")
        wide = baselines.predict({f.name: f.model for f in group}, rows, list(META_COLUMNS), group[0].target)
        usable = " + ".join(f"int(coalesce({col(f.name)} BETWEEN -1e12 AND 1e12, false))" for f in group)
        frames.append(wide.selectExpr(f"{quote(dataset)} AS dataset", f"{quote(horizon)} AS horizon", *META_COLUMNS, "double(actual) AS actual", f"{usable} AS usable"))
    return reduce(DataFrame.unionByName, frames)


def baseline_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a linear model before and after writing it, and how many differ."""
    p = i.prepared(spark, sf)
    rows = p.scaled("core")
    features = feature_columns(rows, p.target)
    fitted = baselines.fit(rows.filter("split = 'train'"), "Linear Regression", features, p.target)
    base = scratch_path(spark, "baseline-models")
    models.save_baseline(fitted, base, "core", "Linear Regression", "1h")
    loaded = models.load_baseline(base, "core", "Linear Regression", "1h")
    test = rows.filter("split = 'test'")
    first = loaded.transform(fitted.transform(test).drop("features").withColumnRenamed("prediction", "before"))
    return first.selectExpr("count(*) AS rows", "count_if(abs(before - prediction) > 1e-9) AS different")


def _fitted(spark: SparkSession, sf: str, n_mfs: int = 2) -> tuple[train.FitData, fuzzy.FuzzyModel]:
    data = train.fit_data(i.prepared(spark, sf), i.VALIDATION_START, i.TRAIN_END)
    return data, train.fit_horizons([data], n_mfs)["1h"]


def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a model before and after writing it, and how many differ."""
    data, model = _fitted(spark, sf)
    base = scratch_path(spark, "fuzzy-models")
    models.save_model(spark, model, base, "m1")
    loaded = models.load_model(spark, base, "m1")
    both = fuzzy.score(fuzzy.score(data.rows, model, "before"), loaded, "after")
    return both.selectExpr("count(*) AS rows", "count_if(NOT before <=> after) AS different")


def pipeline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Scaler and fuzzy model as a ``pyspark.ml`` pipeline: fitted, saved, loaded and applied; rows whose
    prediction differs from the loaded pipeline's, or from that of the plain functions."""
    wide = add_split(i.stored_wide(spark, sf), i.TRAIN_END).selectExpr("*", "double(target_1h) AS label")
    train_rows, inputs = wide.where("split = 'train'"), list(CORE_FEATURES)
    fitted = Pipeline(stages=[estimators.MinMaxColumns(inputs), estimators.FuzzyRegressor(inputs, nMfs=2)]).fit(train_rows)
    path = scratch_path(spark, "pipeline")
    fitted.write().save(path)
    loaded = PipelineModel.load(path)
    keyed = ["profile_code", "datetime", "prediction"]
    stats = collect_stats(minmax_stats(train_rows, inputs))
    plain = put(wide, {c: scaled(c, stats) for c in inputs})
    start = fuzzy.initialize_memberships(plain.where("split = 'train'"), CORE_FEATURES, 2)
    model = fuzzy.fit_consequents(plain.where("split = 'train'"), start, ["label"])["label"]
    first, second, third = (df.select(*keyed) for df in (fitted.transform(wide), loaded.transform(wide), fuzzy.score(plain, model)))
    both = first.join(second.withColumnRenamed("prediction", "again"), keyed[:2]).join(third.withColumnRenamed("prediction", "other"), keyed[:2])
    return both.selectExpr(
        "count(*) AS rows", "count_if(NOT prediction <=> again) AS different",
        "count_if(NOT coalesce(abs(prediction - other) < 1e-6D, false)) AS unlike",
    )


def test_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction frames of the fitted model on the test split, both horizons; ``agrees`` compares every
    prediction with the forward pass in SQL expressions."""
    data, models_ = train.fit_wide(i.stored_wide(spark, sf), i.VALIDATION_START, i.TRAIN_END, 2)
    frames = []
    for h, d in data.items():
        frame = train.test_predictions(d, models_[h])
        again = fuzzy.sugeno_rows(d.rows.where("split = 'test'"), models_[h], list(META_COLUMNS), "p")
        shown = again.selectExpr("profile_code", f"date_format(datetime, '{files.TIMESTAMP_TEXT}') AS datetime", f"{unscaled('p', d.target, d.stats)} AS _again")
        both = frame.join(shown, ["profile_code", "datetime"])
        frames.append(
            both.selectExpr(
                f"{quote(h)} AS horizon", "profile_code", "profile_name", "datetime", "actual_kwh", "baseline_lag24_kwh",
                "coalesce(abs(predicted_kwh - _again) < 1e-6D, false) AS agrees",
            )
        )
    return reduce(DataFrame.unionByName, frames)


def _records(spark: SparkSession, sf: str, n_mfs: int, run: str) -> DataFrame:
    """Run records of both horizons, with ``agrees``: every metric against a second computation."""
    data, models_ = train.fit_wide(i.stored_wide(spark, sf), i.VALIDATION_START, i.TRAIN_END, n_mfs)
    frames = []
    for h, d in data.items():
        record = train.run_records(d, models_[h], run, i.VALIDATION_START)
        scored = fuzzy.sugeno_rows(d.rows, models_[h], ["split", f"double({d.target}_scaled) AS ys", f"double({d.target}) AS y"], "ps")
        raw = scored.selectExpr("split", "ys - ps AS es", "y", f"y - ({unscaled('ps', d.target, d.stats)}) AS e")
        parts = [f"pow(avg(es * es) FILTER (WHERE split = '{s}'), 0.5D) AS {n}" for s, n in (("train_fit", "a"), ("validation", "b"))]
        test = list(_SECOND)
        other = raw.selectExpr(f"{quote(h)} AS horizon", *parts).join(raw.where("split = 'test'").selectExpr(f"{quote(h)} AS horizon", *test), "horizon")
        pairs = {"train_rmse_scaled": "a", "validation_rmse_scaled": "b", **{f"test_{m}": f"{m}_2" for m in METRICS}}
        same = " AND ".join(f"coalesce(abs({x} - {y}) <= 1e-6D * greatest(1D, abs({x})), false)" for x, y in pairs.items())
        frames.append(record.join(other, "horizon").selectExpr(*record.columns, f"{same} AS agrees"))
    return reduce(DataFrame.unionByName, frames)


_RECORD = ["run_id", "horizon", "train_fit_rows", "validation_rows", "test_rows", "n_mfs", "n_rules", "predictions_finite", "agrees"]


def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, with two and with the published three sets, both horizons, written and read back."""
    path = scratch_path(spark, "runs")
    for n_mfs in (2, 3):
        files.append_runs(_records(spark, sf, n_mfs, f"0{n_mfs}"), path)
    return files.read_runs(spark, path).select(*_RECORD)


def runs_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """One run written twice, the second time with other settings, and another run once: two runs remain."""
    path = scratch_path(spark, "runs")
    first = stored(_records(spark, sf, 1, "001"), "run-record")
    for run in (first, _records(spark, sf, 1, "other"), first.withColumn("ridge_alpha", F.lit(0.5))):
        files.append_runs(run, path)
    return files.read_runs(spark, path).select("run_id", "horizon", "test_rows", "ridge_alpha")


QUERIES = {
    f.__name__: f
    for f in (
        baseline_linear, baseline_tree, baseline_forest, baseline_boosted, baseline_comparison,
        baseline_predictions_wide, baseline_model_roundtrip, model_roundtrip, pipeline_roundtrip, test_predictions, run_records, runs_repeated,
    )
}

_COUNTS = """count(*) FILTER (WHERE fit_split = 'train_fit') AS train_fit_rows,
  count(*) FILTER (WHERE fit_split = 'validation') AS validation_rows, count(*) FILTER (WHERE fit_split = 'test') AS test_rows"""
_TEST_ROWS = q.wide_plus(q.splits()) + "SELECT count(*) FILTER (WHERE split = 'test') AS rows, 0 AS different FROM rows1"

_HORIZONS = "(VALUES ('1h'), ('24h')) h(horizon)"
_DATASETS = "(VALUES ('core'), ('extended')) d(dataset)"
_TESTED = q.wide_plus(q.splits()) + (
    ", tested AS (SELECT '1h' AS horizon, target_1h AS actual, * FROM rows1 WHERE split = 'test' "
    "UNION ALL SELECT '24h', target_24h, * FROM rows1 WHERE split = 'test') "
)

ORACLE = {
    "baseline_model_roundtrip": _TEST_ROWS,
    "pipeline_roundtrip": q.WIDE + "SELECT count(*) AS rows, 0 AS different, 0 AS unlike FROM wide",
    "model_roundtrip": q.WIDE + "SELECT count(*) AS rows, 0 AS different FROM wide",
    "run_records": q.wide_plus(q.splits())
    + f"""SELECT '0' || n_mfs AS run_id, horizon, {_COUNTS}, n_mfs, CAST(n_mfs ** 6 AS INTEGER) AS n_rules, true AS predictions_finite, true AS agrees
       FROM rows1, (VALUES (2), (3)) v(n_mfs), {_HORIZONS} GROUP BY n_mfs, horizon""",
    "runs_repeated": q.wide_plus(q.splits())
    + f"""SELECT run_id, horizon, count(*) FILTER (WHERE fit_split = 'test') AS test_rows, ridge_alpha
       FROM rows1, (VALUES ('001', 5e-1), ('other', {q.d(RIDGE_ALPHA)})) v(run_id, ridge_alpha), {_HORIZONS} GROUP BY run_id, horizon, ridge_alpha""",
    "test_predictions": _TESTED
    + """SELECT horizon, profile_code, profile_name, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, actual AS actual_kwh,
       load_lag_24 AS baseline_lag24_kwh, true AS agrees FROM tested""",
    "baseline_predictions_wide": _TESTED
    + f"""SELECT dataset, horizon, profile_code, profile_name, datetime, CAST(actual AS DOUBLE) AS actual, 4 AS usable FROM tested, {_DATASETS}""",
    "baseline_comparison": q.wide_plus(q.splits())
    + f"""SELECT dataset, horizon, metric, {", ".join(f'true AS "{n}"' for n in baselines.MODEL_NAMES)}, count(*) AS rows
       FROM rows1, {_HORIZONS}, {_DATASETS}, (VALUES {", ".join(f"('{m}')" for m in METRICS)}) m(metric) WHERE split = 'test' GROUP BY 1, 2, 3""",
    **{
        name: q.wide_plus(q.splits())
        + f"SELECT '{dataset}' AS dataset, '1h' AS horizon, '{model}' AS model, count(*) AS rows, CAST(0 AS BIGINT) AS different FROM rows1 WHERE split = 'test'"
        for name, dataset, model in (
            ("baseline_linear", "extended", "Linear Regression"), ("baseline_tree", "extended", "Decision Tree"),
            ("baseline_forest", "core", "Random Forest"), ("baseline_boosted", "core", "Boosted Trees"),
        )
    },
}
