"""Four baseline regressors through ``pyspark.ml`` and the lag-24 persistence forecast."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.fixed_values import TREE_SEED
from gridweave.functions.errors import METRICS, metric_aggregates
from gridweave.functions.text import Expr, col, quote, select, table
from gridweave.operators.quality import DataQualityError
from gridweave.operators.scaling import Stats, unscaled
from gridweave.operators.summary import grouped
from gridweave.session import ensure_checkpoint_dir

# --- fixed values: model parameters ------------------------------------------------------
TREE_DEPTH = 10
FOREST_TREES, FOREST_DEPTH = 100, 15
BOOST_ROUNDS, BOOST_RATE, BOOST_DEPTH = 200, 0.05, 5
TREE_BINS = 256
LAG_COLUMN = "load_lag_24"
MODEL_NAMES = ("Linear Regression", "Decision Tree", "Random Forest", "Boosted Trees")


def regressors(**sizes: int) -> dict[str, object]:
    """Fresh estimators. ``sizes`` (forest_trees, boost_rounds) shrinks the ensembles for tests."""
    common = {"featuresCol": "features", "labelCol": "label"}
    trees = {**common, "maxBins": TREE_BINS, "seed": TREE_SEED, "checkpointInterval": 10}
    # deep trees keep each row's node instead of walking the tree again at every level
    deep = {**trees, "cacheNodeIds": True}
    return {
        # collinear calendar columns leave the direct solver without a unique solution; the iterations go on to this tolerance
        "Linear Regression": LinearRegression(**common, regParam=0.0, tol=1e-9, maxIter=500),
        "Decision Tree": DecisionTreeRegressor(**deep, maxDepth=TREE_DEPTH),
        "Random Forest": RandomForestRegressor(
            **deep,
            numTrees=sizes.get("forest_trees", FOREST_TREES),
            maxDepth=FOREST_DEPTH,
            featureSubsetStrategy="all",
        ),
        "Boosted Trees": GBTRegressor(
            **trees,
            maxIter=sizes.get("boost_rounds", BOOST_ROUNDS),
            stepSize=BOOST_RATE / 2,  # a stage is fitted to twice the residual
            maxDepth=BOOST_DEPTH,
            lossType="squared",
        ),
    }


def fit(train: DataFrame, name: str, features: list[str], target: str, **sizes: int) -> PipelineModel:
    """Scaled features against the raw target."""
    ensure_checkpoint_dir(train.sparkSession)
    labelled = train.selectExpr(*select(features, {"label": f"double({col(target)})"}))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, regressors(**sizes)[name]]).fit(labelled)


def predict(models: dict[str, PipelineModel], df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Keys, actual value and one prediction column per model: one pass, no shuffle."""
    wide = df
    for name, model in models.items():
        # every stage adds its columns; they are dropped again before the next model adds its own
        wide = model.transform(wide).withColumnRenamed("prediction", name).drop("features")
    return wide.selectExpr(*select(keys, {"actual": col(target)}), *[col(n) for n in models])


def predictions_long(wide: DataFrame, names: list[str], extra: dict[str, Expr] | None = None) -> DataFrame:
    """One row per key and model."""
    entries = table({"model": quote(n), "prediction": col(n)} for n in names)
    kept = [c for c in wide.columns if c not in names]
    return wide.selectExpr(*select(kept, extra or {}), f"inline({entries})")


def score_models(long: DataFrame, by: list[str]) -> DataFrame:
    return grouped(long, by, metric_aggregates("actual", "prediction"))


def comparison_table(metrics: DataFrame) -> DataFrame:
    """One row per (dataset, horizon, metric), one column per model."""
    entries = table({"metric": quote(m), "value": m} for m in METRICS)
    long = metrics.selectExpr("dataset", "horizon", "model", f"inline({entries})")
    return long.groupBy("dataset", "horizon", "metric").pivot("model", list(MODEL_NAMES)).agg(F.first("value"))


def persistence(df: DataFrame, stats: Stats | None = None, scaled_name: str = "load_lag_24_scaled") -> Expr:
    """The load 24 rows before the feature row, from the raw column or else the scaled one."""
    sources = []
    if LAG_COLUMN in df.columns:
        sources.append(LAG_COLUMN)
    if scaled_name in df.columns and stats is not None:
        sources.append(unscaled(scaled_name, LAG_COLUMN, stats))
    if not sources:
        raise DataQualityError("cannot build the lag-24 baseline: load_lag_24 is missing")
    return f"coalesce({', '.join(sources)})"
