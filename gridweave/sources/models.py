"""Fitted models as Parquet tables: sets, rules, coefficients and metadata, a folder per model id."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from gridweave.fixed_values import EPS, MIN_SIGMA, RIDGE_ALPHA, SEED
from gridweave.operators.fuzzy import FuzzyModel
from gridweave.operators.quality import DataQualityError, missing_columns

MODEL_VERSION = "1.0"
TABLES = {
    "mf": "input int, feature string, mf int, mu double, sigma double",
    "rules": "rule int, input int, mf int",
    "coef": "rule int, term int, value double",
    "meta": "key string, value string",
}
REQUIRED = {
    "mf": ["input", "feature", "mf", "mu", "sigma"],
    "rules": ["rule", "input", "mf"],
    "coef": ["rule", "term", "value"],
    "meta": ["key", "value"],
}


def _path(base: str, table: str, model_id: str) -> str:
    return f"{base}/{table}/model_id={model_id}"


def model_rows(model: FuzzyModel) -> dict[str, list[tuple]]:
    """The four tables as rows; their size depends on the rule grid only."""
    settings = {
        "ridge_alpha": model.ridge_alpha,
        "min_sigma": model.min_sigma,
        "eps": model.eps,
        "seed": model.seed,
    }
    meta = {
        "model_version": MODEL_VERSION,
        "model_scope": "global",
        "n_inputs": str(len(model.features)),
        "n_mfs": str(model.n_mfs),
        "n_rules": str(model.n_rules),
        "settings": json.dumps(settings),
        **model.metadata,
    }
    return {
        "mf": [
            (i, f, j, float(model.mu[i, j]), float(model.sigma[i, j]))
            for i, f in enumerate(model.features)
            for j in range(model.n_mfs)
        ],
        "rules": [(r, i, int(j)) for r, rule in enumerate(model.rules) for i, j in enumerate(rule)],
        "coef": [(r, t, float(v)) for r, row in enumerate(model.coefficients) for t, v in enumerate(row)],
        "meta": list(meta.items()),
    }


def save_model(spark: SparkSession, model: FuzzyModel, base: str, model_id: str) -> None:
    for table, rows in model_rows(model).items():
        df = spark.createDataFrame(rows, TABLES[table]).coalesce(1)
        df.write.mode("overwrite").parquet(_path(base, table, model_id))


def _read(spark: SparkSession, base: str, table: str, model_id: str) -> DataFrame:
    try:
        df = spark.read.parquet(_path(base, table, model_id))
    except AnalysisException as error:
        raise DataQualityError(f"model {model_id!r} has no table {table!r}") from error
    missing = missing_columns(df, REQUIRED[table])
    if missing:
        raise DataQualityError(f"model table {table!r} is missing columns: {missing}")
    return df


def load_model(spark: SparkSession, base: str, model_id: str) -> FuzzyModel:
    """Reads the four tables; settings that were not stored take their defaults."""
    mf = _read(spark, base, "mf", model_id).orderBy("input", "mf").collect()
    rules = _read(spark, base, "rules", model_id).orderBy("rule", "input").collect()
    coef = _read(spark, base, "coef", model_id).orderBy("rule", "term").collect()
    meta = {r["key"]: r["value"] for r in _read(spark, base, "meta", model_id).collect()}
    settings = json.loads(meta.pop("settings", "{}"))
    n_mfs = max(r["mf"] for r in mf) + 1
    features = tuple(r["feature"] for r in mf if r["mf"] == 0)
    return FuzzyModel(
        features=features,
        mu=np.array([r["mu"] for r in mf]).reshape(-1, n_mfs),
        sigma=np.array([r["sigma"] for r in mf]).reshape(-1, n_mfs),
        rules=np.array([r["mf"] for r in rules]).reshape(-1, len(features)),
        coefficients=np.array([r["value"] for r in coef]).reshape(-1, len(features) + 1),
        ridge_alpha=settings.get("ridge_alpha", RIDGE_ALPHA),
        min_sigma=settings.get("min_sigma", MIN_SIGMA),
        eps=settings.get("eps", EPS),
        seed=settings.get("seed", SEED),
        metadata=meta,
    )


def baseline_path(base: str, dataset: str, model: str, horizon: str) -> str:
    return f"{base}/baselines/dataset={dataset}/model={model.replace(' ', '_').lower()}/horizon={horizon}"


def save_baseline(model: PipelineModel, base: str, dataset: str, name: str, horizon: str) -> str:
    path = baseline_path(base, dataset, name, horizon)
    model.write().overwrite().save(path)
    return path


def load_baseline(base: str, dataset: str, name: str, horizon: str) -> PipelineModel:
    return PipelineModel.load(baseline_path(base, dataset, name, horizon))


def model_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    """All saved models of one table, with their ids."""
    return spark.read.parquet(f"{base}/{table}").withColumn("model_id", F.col("model_id").cast("string"))
