"""The scaler and the fuzzy model as stages of ``pyspark.ml``."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from gridweave.operators.estimators import FuzzyRegressionModel, FuzzyRegressor, MinMaxColumns, MinMaxColumnsModel

INPUTS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    x = draw.random((400, 2)) * [50, 3] + [10, -1]
    y = np.sin(x[:, 0] / 8) + x[:, 1] ** 2
    return spark.createDataFrame(pd.DataFrame(x, columns=INPUTS).assign(label=y, id=range(400)))


def test_pipeline_saves_and_loads(rows, tmp_path):
    stages = [MinMaxColumns(INPUTS), FuzzyRegressor(INPUTS, nMfs=3, ridgeAlpha=1e-3, predictionCol="p")]
    fitted = Pipeline(stages=stages).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    a, b = (m.transform(rows).orderBy("id").toPandas()["p"] for m in (fitted, loaded))
    np.testing.assert_array_equal(a, b)
    assert np.sqrt(np.mean((a - rows.orderBy("id").toPandas()["label"]) ** 2)) < 0.1
    assert [type(s) for s in loaded.stages] == [MinMaxColumnsModel, FuzzyRegressionModel]
    assert loaded.stages[1].getOrDefault("nMfs") == 3 and loaded.stages[1].uid == fitted.stages[1].uid


def test_estimators_save_and_load(tmp_path):
    FuzzyRegressor(INPUTS, nMfs=4).write().overwrite().save(str(tmp_path / "e"))
    loaded = FuzzyRegressor.load(str(tmp_path / "e"))
    assert loaded.getColumns() == INPUTS and loaded.getOrDefault("nMfs") == 4 and loaded.getPredictionCol() == "prediction"


def test_cross_validation_chooses_the_finer_grid(rows):
    regressor = FuzzyRegressor(INPUTS)
    pipeline = Pipeline(stages=[MinMaxColumns(INPUTS), regressor])
    grid = ParamGridBuilder().addGrid(regressor.nMfs, [1, 3]).build()
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), numFolds=2, seed=1).fit(rows)
    assert found.bestModel.stages[1].getOrDefault("nMfs") == 3 and found.avgMetrics[1] < found.avgMetrics[0]


def test_input_is_left_alone_and_labels_are_not_scaled(rows):
    fitted = MinMaxColumns(INPUTS).fit(rows)
    scaled = fitted.transform(rows).selectExpr("min(a)", "max(a)", "min(b)", "max(b)", "max(label)").first()
    assert tuple(scaled)[:4] == (0.0, 1.0, 0.0, 1.0) and scaled[4] == rows.selectExpr("max(label)").first()[0]
