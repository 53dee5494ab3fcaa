"""Fit, score and evaluate the fuzzy model; fit and compare the baselines."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from gridweave.fixed_values import (
    CORE_FEATURES,
    META_COLUMNS,
    N_MFS,
    RIDGE_ALPHA,
    TARGETS,
    TRAIN_END,
    VALIDATION_START,
)
from gridweave.functions.errors import metric_aggregates
from gridweave.functions.text import Expr, add, any_of, array, col, cols, num, quote, select, table
from gridweave.operators import baselines, evaluate, fuzzy
from gridweave.operators.quality import (
    DataQualityError,
    invalid_row,
    quality_checks,
    raise_on_violations,
    raw_scaled_parity,
    require_columns,
    stats_coverage,
)
from gridweave.operators.scaling import Stats, feature_columns, scaled_target, stats_table, unscaled
from gridweave.operators.splits import add_fit_split, require_splits
from gridweave.plans.preprocess import ALL_FEATURES, Prepared, prepare
from gridweave.session import stored, stored_observed
from gridweave.sources.models import save_baseline

SPLITS = ("train_fit", "validation", "test")
# what the evaluation of a row needs
NEEDED = ("predicted", "raw_lag_24")
# baseline fits submitted at a time; of those with a model of many thousand nodes, which grows on the driver, one
SIDE_BY_SIDE = 4
ALONE = "Random Forest"


@dataclass(frozen=True)
class FitData:
    """One frame per horizon: keys, scaled features, raw lag, target, scaled target, split."""

    horizon: str
    target: str
    rows: DataFrame
    stats: Stats


def fit_data(
    prepared: Prepared, validation_start: str = VALIDATION_START, train_end: str = TRAIN_END
) -> FitData:
    """Scaled core rows with the raw lag kept beside them; scaled and raw never part."""
    rows = prepared.scaled("core", extra={"raw_lag_24": "load_lag_24"})
    return FitData(prepared.horizon, prepared.target, add_fit_split(rows, validation_start, train_end), prepared.stats)


def fit_data_from_files(
    scaled: DataFrame, raw: DataFrame, stats: Stats, horizon: str, target: str,
    validation_start: str = VALIDATION_START, train_end: str = TRAIN_END,
    features: tuple[str, ...] = CORE_FEATURES,
) -> FitData:
    """Written scaled and raw splits back into one frame, after the checks on both."""
    spark = scaled.sparkSession
    require_columns(scaled, [*META_COLUMNS, *features, target, f"{target}_scaled"], "scaled data")
    require_columns(raw, [*META_COLUMNS, *features, target], "raw data")
    raise_on_violations(quality_checks(scaled, [*features, f"{target}_scaled"], [target], "datetime"), "scaled data")
    raise_on_violations(quality_checks(raw, list(features), [target], "datetime"), "raw data")
    gaps = stats_coverage(spark, stats_table(spark, stats), [*features, target]).collect()
    if gaps:
        raise DataQualityError(f"scaler statistics: {[(g['column'], g['problem']) for g in gaps]}")
    parity = raw_scaled_parity(raw, scaled, list(META_COLUMNS), target).first()
    if parity["key_mismatches"] or parity["target_mismatches"] or parity["raw_rows"] != parity["scaled_rows"]:
        raise DataQualityError(f"raw and scaled rows do not match: {parity.asDict()}")
    if parity["repeated_keys"]:
        raise DataQualityError(f"{parity['repeated_keys']} repeated keys")
    key = f"struct({cols(META_COLUMNS)}) AS _g"
    lag = raw.selectExpr(key, "load_lag_24 AS raw_lag_24")
    rows = scaled.drop("split").selectExpr("*", key).join(lag, "_g").drop("_g")
    return FitData(horizon, target, add_fit_split(rows, validation_start, train_end), stats)


def fit_horizons(
    data: list[FitData], n_mfs: int = N_MFS, alpha: float = RIDGE_ALPHA, features: tuple[str, ...] = CORE_FEATURES,
    iterative: bool | None = None,
) -> dict[str, fuzzy.FuzzyModel]:
    """One model per horizon, each from its own training rows."""
    out = {}
    for d in data:
        sizes = require_splits(d.rows, SPLITS)
        train = d.rows.filter("split = 'train_fit'")
        start = fuzzy.initialize_memberships(train, features, n_mfs, rows=sizes["train_fit"])
        target = f"{d.target}_scaled"
        fitted = fuzzy.fit_consequents(train, start, [target], alpha, iterative)[target]
        out[d.horizon] = replace(fitted, metadata={"horizon": d.horizon, "target_column": d.target})
    return out


def horizons_agree(wide: DataFrame) -> bool:
    """Whether every row is valid for all horizons or for none: one aggregate."""
    bad = [invalid_row(ALL_FEATURES, t) for t in TARGETS.values()]
    differs = any_of(f"{b} <> {bad[0]}" for b in bad[1:])
    return wide.selectExpr(f"count_if(coalesce({differs}, true)) AS n").first()["n"] == 0


def fit_wide(
    wide: DataFrame,
    validation_start: str = VALIDATION_START,
    train_end: str = TRAIN_END,
    n_mfs: int = N_MFS,
    alpha: float = RIDGE_ALPHA,
    iterative: bool | None = None,
) -> tuple[dict[str, FitData], dict[str, fuzzy.FuzzyModel]]:
    """Models of all horizons from one wide table.

    Horizons that keep the same rows have the same scaled inputs, so they share the quantiles and
    one pass for D'D and every D'y. Otherwise each horizon is fitted on its own rows.
    """
    prepared = {h: prepare(wide, h, train_end) for h in TARGETS}
    data = {h: fit_data(p, validation_start, train_end) for h, p in prepared.items()}
    if not horizons_agree(wide):
        return data, fit_horizons(list(data.values()), n_mfs, alpha, iterative=iterative)
    first = next(iter(prepared.values()))
    extra = {f"y_{h}": scaled_target(p.target, p.stats) for h, p in prepared.items()}
    rows = add_fit_split(first.scaled("core", extra=extra), validation_start, train_end)
    sizes = require_splits(rows, SPLITS)
    train = rows.filter("split = 'train_fit'")
    start = fuzzy.initialize_memberships(train, CORE_FEATURES, n_mfs, rows=sizes["train_fit"])
    fitted = fuzzy.fit_consequents(train, start, list(extra), alpha, iterative)
    return data, {
        h: replace(fitted[f"y_{h}"], metadata={"horizon": h, "target_column": p.target}) for h, p in prepared.items()
    }


def score_fit_data(data: FitData, model: fuzzy.FuzzyModel) -> DataFrame:
    """All splits scored in one pass, in scaled and in raw units."""
    scored = fuzzy.score(data.rows, model, "predicted_scaled")
    return add(scored, {"predicted": unscaled("predicted_scaled", data.target, data.stats)})


def fit_diagnostics(scored: DataFrame, target: str) -> DataFrame:
    return fuzzy.split_rmse(scored, f"{target}_scaled", "predicted_scaled")


def test_predictions(data: FitData, model: fuzzy.FuzzyModel, text_time: bool = True) -> DataFrame:
    """Prediction frame of the test split beside the lag-24 forecast.

    The split filter runs before scoring, so only test rows reach Python. The scores are written once:
    the run stops when one of them, or a lag-24 value, is missing or not finite.
    """
    test = replace(data, rows=data.rows.filter("split = 'test'"))
    scored, found = stored_observed(score_fit_data(test, model), f"scored-{data.horizon}", evaluate.gaps(NEEDED))
    evaluate.require_none(found, f"test predictions {data.horizon}")
    return evaluate.prediction_frame(scored, data.target, "predicted", "raw_lag_24", text_time=text_time)


def run_records(
    data: FitData,
    model: fuzzy.FuzzyModel,
    run_id: str,
    validation_start: str = VALIDATION_START,
    paths: dict[str, str] | None = None,
) -> DataFrame:
    """One row per run and horizon: parameters, split rows, scaled and raw-unit metrics.

    ``paths`` names the data read and the artifacts written. Every number comes from one scoring pass over all splits.
    """
    scored, found = stored_observed(score_fit_data(data, model), f"scored-{data.horizon}", evaluate.gaps(NEEDED))
    evaluate.require_none(found, f"predictions {data.horizon}")
    error = f"(predicted_scaled - {data.target}_scaled)"

    def rmse(split: str) -> Expr:
        return f"sqrt(avg(CASE WHEN split = '{split}' THEN {error} * {error} END))"

    test = metric_aggregates(
        f"CASE WHEN split = 'test' THEN {data.target} END", "CASE WHEN split = 'test' THEN predicted END"
    )
    record = {
        "run_id": quote(run_id),
        "run_time": "localtimestamp()",
        "horizon": quote(data.horizon),
        "target_column": quote(data.target),
        "feature_set": quote("core"),
        "paths": "map_from_entries(CAST({} AS ARRAY<STRUCT<name: STRING, path: STRING>>))".format(
            table({"name": quote(n), "path": quote(p)} for n, p in sorted((paths or {}).items()))
        ),
        **{f"{s}_rows": f"count_if(split = '{s}')" for s in SPLITS},
        "ridge_alpha": num(model.ridge_alpha),
        "n_mfs": str(model.n_mfs),
        "n_rules": str(model.n_rules),
        "validation_start": quote(validation_start),
        "seed": str(model.seed),
        "feature_order": array(quote(f) for f in model.features),
        "train_rmse_scaled": rmse("train_fit"),
        "validation_rmse_scaled": rmse("validation"),
        **{f"test_{n}": e for n, e in test.items()},
        "predictions_finite": "count_if(predicted_scaled IS NULL) = 0",
    }
    return scored.selectExpr(*select([], record))


@dataclass(frozen=True)
class BaselineFit:
    """One fitted baseline; ``scored`` has its prediction for the rows of both splits."""

    dataset: str
    horizon: str
    name: str
    target: str
    features: list[str]
    model: PipelineModel
    scored: DataFrame

    @property
    def size(self) -> int:
        """Trees in the model."""
        last = self.model.stages[-1]
        return last.getNumTrees if hasattr(last, "getNumTrees") else int(hasattr(last, "numNodes"))


def fit_baselines(
    prepared: dict[str, Prepared], datasets: tuple[str, ...], names: tuple[str, ...] = baselines.MODEL_NAMES, **sizes: int
) -> list[BaselineFit]:
    """Every model on every feature set and horizon, on the whole training part.

    The scaled rows of a feature set and horizon are written once, so that the many passes of the tree
    learners read a table instead of rebuilding the features. The fits do not depend on each other and
    each is many small jobs, so they are submitted side by side; forests wait for each other, because the
    driver holds a forest several times over while it grows.
    """
    tables = {(d, h): stored(p.scaled(d), f"baseline-{d}-{h}") for h, p in prepared.items() for d in datasets}

    def one(key: tuple[str, str, str]) -> BaselineFit:
        dataset, horizon, name = key
        rows, target = tables[dataset, horizon], prepared[horizon].target
        features = feature_columns(rows, target)
        model = baselines.fit(rows.filter("split = 'train'"), name, features, target, **sizes)
        return BaselineFit(dataset, horizon, name, target, features, model, model.transform(rows).drop("features"))

    # the slow learners first
    keys = [(d, h, n) for n in reversed(names) for d, h in tables]
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool, ThreadPoolExecutor(1) as forests:
        waiting = [(forests if k[2] == ALONE else pool).submit(inheritable_thread_target(one), k) for k in keys]
        done = [w.result() for w in waiting]
    return sorted(done, key=lambda f: (f.dataset, f.horizon, names.index(f.name)))


def train_baselines(
    prepared: Prepared, dataset: str, names: tuple[str, ...] = baselines.MODEL_NAMES, base: str | None = None,
    **sizes: int,
) -> DataFrame:
    """Fits the named models on the whole training part; test predictions, a column per model."""
    fits = fit_baselines({prepared.horizon: prepared}, (dataset,), names, **sizes)
    if base is not None:
        for fit in fits:
            save_baseline(fit.model, base, dataset, fit.name, prepared.horizon)
    test = prepared_test(prepared, dataset)
    return baselines.predict({f.name: f.model for f in fits}, test, list(META_COLUMNS), prepared.target)


def prepared_test(prepared: Prepared, dataset: str) -> DataFrame:
    return prepared.scaled(dataset).filter("split = 'test'")


def all_baseline_rows(prepared: dict[str, Prepared], datasets: tuple[str, ...], **sizes: int) -> DataFrame:
    """Test predictions of all fits as (dataset, horizon, keys, actual, model, prediction) rows."""
    frames = []
    for fit in fit_baselines(prepared, datasets, **sizes):
        values = {
            "dataset": quote(fit.dataset), "horizon": quote(fit.horizon), "actual": col(fit.target),
            "model": quote(fit.name), "prediction": "prediction",
        }
        frames.append(fit.scored.filter("split = 'test'").selectExpr(*select(META_COLUMNS, values)))
    return reduce(DataFrame.unionByName, frames)


def baseline_rows(predictions: DataFrame, dataset: str, horizon: str) -> DataFrame:
    """Predictions of one run as (dataset, horizon, keys, actual, model, prediction) rows."""
    names = [c for c in predictions.columns if c not in {*META_COLUMNS, "actual"}]
    return baselines.predictions_long(predictions, names, {"dataset": quote(dataset), "horizon": quote(horizon)})
