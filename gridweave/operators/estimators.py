"""The scaler and the fuzzy model as ``pyspark.ml`` stages, for pipelines, grids and cross validation.

They work on named columns: the scaler replaces its columns by their scaled values, the regressor reads its
inputs and adds a prediction. Fitted stages are saved as metadata and small tables beside it.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from gridweave.fixed_values import MIN_SIGMA, N_MFS, RIDGE_ALPHA, SEED
from gridweave.functions.text import put
from gridweave.operators import fuzzy
from gridweave.operators.scaling import ColumnStats, Stats, collect_stats, minmax_stats, scaled
from gridweave.sources.models import load_model, save_model


class HasColumns(Params):
    columns = Param(Params._dummy(), "columns", "the columns that the stage reads", TypeConverters.toListString)

    def getColumns(self) -> list[str]:
        return self.getOrDefault(self.columns)


class _Writer(MLWriter):
    """Parameters by the writer of ``pyspark.ml``; what was fitted by the stage itself."""

    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=self.stage._fitted_metadata())
        self.stage._save_fitted(self.sparkSession, path)


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind._load_fitted(self.sparkSession, path, metadata)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class _Fitted(Model, MLWritable, MLReadable):
    """A fitted stage that is written with its parameters."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _fitted_metadata(self) -> dict:
        return {}

    def _save_fitted(self, spark: SparkSession, path: str) -> None:
        """Tables beside the metadata."""


class MinMaxColumns(Estimator, HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    """Min-max statistics of columns from one aggregate."""

    def __init__(self, columns: list[str] | None = None):
        super().__init__()
        if columns is not None:
            self._set(columns=columns)

    def _fit(self, dataset: DataFrame) -> MinMaxColumnsModel:
        stats = collect_stats(minmax_stats(dataset, self.getColumns()))
        return self._copyValues(MinMaxColumnsModel(stats))


class MinMaxColumnsModel(_Fitted, HasColumns):
    def __init__(self, stats: Stats | None = None):
        super().__init__()
        self.stats = stats or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return put(dataset, {c: scaled(c, self.stats) for c in self.getColumns()})

    def _fitted_metadata(self) -> dict:
        return {"stats": json.dumps({c: [s.lo, s.hi, s.span] for c, s in self.stats.items()})}

    @classmethod
    def _load_fitted(cls, spark: SparkSession, path: str, metadata: dict) -> MinMaxColumnsModel:
        return cls({c: ColumnStats(*v) for c, v in json.loads(metadata["stats"]).items()})


class _FuzzyParams(HasColumns, HasLabelCol, HasPredictionCol, HasSeed):
    nMfs = Param(Params._dummy(), "nMfs", "fuzzy sets for each input", TypeConverters.toInt)
    ridgeAlpha = Param(Params._dummy(), "ridgeAlpha", "ridge penalty of every coefficient", TypeConverters.toFloat)
    minSigma = Param(Params._dummy(), "minSigma", "least width of a set", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(nMfs=N_MFS, ridgeAlpha=RIDGE_ALPHA, minSigma=MIN_SIGMA, seed=SEED, labelCol="label", predictionCol="prediction")


class FuzzyRegressor(Estimator, _FuzzyParams, DefaultParamsReadable, DefaultParamsWritable):
    """Set centers from quantiles, rule outputs by ridge regression; see ``fuzzy``."""

    def __init__(self, columns: list[str] | None = None, **params):
        super().__init__()
        self._defaults()
        self._set(**{**params, **({} if columns is None else {"columns": columns})})

    def _fit(self, dataset: DataFrame) -> FuzzyRegressionModel:
        label = self.getLabelCol()
        start = fuzzy.initialize_memberships(dataset, tuple(self.getColumns()), self.getOrDefault(self.nMfs), self.getOrDefault(self.minSigma))
        model = fuzzy.fit_consequents(dataset, start, [label], self.getOrDefault(self.ridgeAlpha))[label]
        return self._copyValues(FuzzyRegressionModel(model))


class FuzzyRegressionModel(_Fitted, _FuzzyParams):
    def __init__(self, model: fuzzy.FuzzyModel | None = None):
        super().__init__()
        self._defaults()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return fuzzy.score(dataset, self.model, self.getPredictionCol())

    def _save_fitted(self, spark: SparkSession, path: str) -> None:
        save_model(spark, self.model, f"{path}/tables", "model")

    @classmethod
    def _load_fitted(cls, spark: SparkSession, path: str, metadata: dict) -> FuzzyRegressionModel:
        return cls(load_model(spark, f"{path}/tables", "model"))
