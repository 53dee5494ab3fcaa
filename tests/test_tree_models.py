"""Trees as Spark expressions, and the conditions that define their leaves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

from gridweave.operators import baselines, tree_models
from gridweave.operators.quality import DataQualityError

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    x = draw.random((600, 3)).round(3)
    y = np.sin(6 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0.4) + draw.normal(0, 0.05, 600)
    return spark.createDataFrame(pd.DataFrame(x, columns=FEATURES).assign(label=y, id=range(600))).repartition(3)


MODELS = {
    "linear": lambda: LinearRegression(),
    "tree": lambda: DecisionTreeRegressor(maxDepth=7, seed=1),
    "forest": lambda: RandomForestRegressor(numTrees=7, maxDepth=6, seed=1, featureSubsetStrategy="all"),
    "boosted": lambda: GBTRegressor(maxIter=12, maxDepth=3, stepSize=0.1, seed=1),
}


@pytest.fixture(scope="module")
def fitted(rows):
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return {name: m().fit(vectors) for name, m in MODELS.items()}, vectors


@pytest.mark.parametrize("name", MODELS)
def test_expression_equals_the_model(fitted, name):
    model, vectors = fitted[0][name], fitted[1]
    both = model.transform(vectors).selectExpr("prediction", f"{tree_models.expression(model, FEATURES)} AS again").toPandas()
    np.testing.assert_allclose(both["again"], both["prediction"], rtol=1e-12)


def test_nodes_are_all_read(fitted):
    models, _ = fitted
    for name in ("tree", "forest", "boosted"):
        trees = tree_models.read_trees(models[name], FEATURES)
        nodes = models[name].numNodes if name == "tree" else models[name].totalNumNodes
        assert len(trees.feature) == nodes
        inner = [i for i, f in enumerate(trees.feature) if f >= 0]
        assert all(i + 1 < trees.right[i] < nodes for i in inner) and len(inner) == (nodes - len(trees.roots)) // 2


def test_every_leaf_holds_its_condition(fitted):
    models, vectors = fitted
    for name in ("tree", "boosted"):
        assert tree_models.wrong_boosted_leaves(vectors, tree_models.read_trees(models[name], FEATURES), "label") == 0
    assert tree_models.wrong_forest_leaves(vectors, tree_models.read_trees(models["forest"], FEATURES), "label") == 0


def test_wrong_leaves_are_seen(fitted):
    from dataclasses import replace

    models, vectors = fitted
    boosted = tree_models.read_trees(models["boosted"], FEATURES)
    leaf = max(i for i, f in enumerate(boosted.feature) if f < 0)
    moved = replace(boosted, value=tuple(v + 0.01 * (i == leaf) for i, v in enumerate(boosted.value)))
    assert tree_models.wrong_boosted_leaves(vectors, moved, "label") == 1
    assert tree_models.wrong_boosted_leaves(vectors, replace(boosted, weights=(*boosted.weights[:5], 0.3, *boosted.weights[6:])), "label") > 1
    forest = tree_models.read_trees(models["forest"], FEATURES)
    leaf = next(i for i, f in enumerate(forest.feature) if f < 0)
    high = replace(forest, value=tuple(99.0 if i == leaf else v for i, v in enumerate(forest.value)))
    assert tree_models.wrong_forest_leaves(vectors, high, "label") == 1


def test_single_leaf_and_missing_split(spark, fitted):
    from pyspark.ml.feature import VectorAssembler

    flat = spark.createDataFrame([(0.5, 0.5, 0.5, 2.0)] * 9, "a double, b double, c double, label double")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(flat)
    model = MODELS["tree"]().fit(vectors)
    assert [r["p"] for r in flat.selectExpr(f"{tree_models.expression(model, FEATURES)} AS p").collect()] == [2.0] * 9

    class Categorical:
        toDebugString = "DecisionTreeRegressionModel: depth=1\n  If (feature 0 in {0.0})\n   Predict: 1.0\n"

    with pytest.raises(DataQualityError, match="not a split of a number"):
        tree_models.read_trees(Categorical(), FEATURES)


def test_a_stage_adds_the_published_share_of_the_residual(spark):
    """A stage fits twice the residual, so half the published rate makes it move by the rate."""
    assert 2 * baselines.regressors()["Boosted Trees"].getStepSize() == pytest.approx(baselines.BOOST_RATE)


def test_written_trees_score_alike_in_a_plan_of_one_size(fitted):
    """The nodes are in a table, not in the plan that Spark prints and keeps."""
    models, vectors = fitted
    lengths = {}
    for name in MODELS:
        both = tree_models.predicted(models[name].transform(vectors), models[name], FEATURES, "again")
        assert "_nodes" not in both.columns
        found = both.select("prediction", "again").toPandas()
        np.testing.assert_allclose(found["again"], found["prediction"], rtol=1e-12)
        lengths[name] = len(both.select("again")._jdf.queryExecution().toString())
    small = RandomForestRegressor(numTrees=7, maxDepth=1, seed=1, featureSubsetStrategy="all").fit(vectors)
    short = len(tree_models.predicted(small.transform(vectors), small, FEATURES, "again").select("again")._jdf.queryExecution().toString())
    assert models["forest"].totalNumNodes > 10 * small.totalNumNodes
    assert lengths["forest"] < 1.3 * short


def test_written_trees_hold_the_nodes_that_are_read(spark, fitted):
    models, vectors = fitted
    for name in ("tree", "forest", "boosted"):
        read, written = tree_models.read_trees(models[name], FEATURES), tree_models.write_trees(models[name], FEATURES, spark)
        row = written.nodes.first()
        assert tuple(row["feature"]) == read.feature and tuple(row["right"]) == read.right and tuple(row["value"]) == read.value
        assert (written.roots, written.depth) == (read.roots, read.depth) and written.weights == pytest.approx(read.weights)
        wrong = tree_models.wrong_forest_leaves if name == "forest" else tree_models.wrong_boosted_leaves
        assert wrong(vectors, written, "label") == 0


def test_leaves_are_checked_on_every_core(spark, fitted):
    """One file is one task; the walk deals its rows out first."""
    models, vectors = fitted
    walked = tree_models.stage_rows(vectors.coalesce(1), tree_models.write_trees(models["boosted"], FEATURES, spark), "label")
    assert walked.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_forests_grow_one_at_a_time(spark, monkeypatch):
    """The driver holds a growing forest several times over."""
    import threading
    import time
    from types import SimpleNamespace

    from gridweave.plans import train

    rows = spark.createDataFrame([(0.5, 1.0, "train")], "a double, y double, split string")
    running, most, lock = {"Random Forest": 0, "Boosted Trees": 0}, {}, threading.Lock()

    def fit(_, name, *rest, **sizes):
        with lock:
            running[name] += 1
            most[name] = max(most.get(name, 0), running[name])
        time.sleep(0.3)
        with lock:
            running[name] -= 1
        return SimpleNamespace(transform=lambda df: df)

    monkeypatch.setattr(train.baselines, "fit", fit)
    prepared = {h: SimpleNamespace(horizon=h, target="y", scaled=lambda d: rows) for h in ("1h", "24h")}
    found = train.fit_baselines(prepared, ("core", "extended"), ("Random Forest", "Boosted Trees"))
    assert [(f.dataset, f.horizon, f.name) for f in found] == [
        (d, h, n) for d in ("core", "extended") for h in ("1h", "24h") for n in ("Random Forest", "Boosted Trees")
    ]
    assert most == {"Random Forest": 1, "Boosted Trees": 4}


def test_expression_scores_use_every_core(spark, fitted, monkeypatch):
    """The written rows of a small table are one file; one task would walk all of them through all trees."""
    from gridweave.catalog import fits

    models, vectors = fitted
    keyed = vectors.drop("features").selectExpr("*", *[f"id AS {c}" for c in fits.META_COLUMNS])
    found, dealt = [], []
    for name in ("tree", "boosted"):
        scored = models[name].transform(keyed.join(vectors.select("id", "features"), "id")).drop("features").coalesce(1)
        found.append(train_fit(name, models[name], scored))
    monkeypatch.setattr(fits, "all_fits", lambda *_: found)
    monkeypatch.setattr(fits, "stored", lambda df, name: dealt.append(df.rdd.getNumPartitions()) or df)
    rows = {r["model"]: (r["rows"], r["different"]) for r in fits.tree_expression_scores(spark, "").collect()}
    assert rows == {"tree": (600, 0), "boosted": (600, 0)}
    assert dealt == [spark.sparkContext.defaultParallelism]


def train_fit(name, model, scored):
    from types import SimpleNamespace

    from gridweave.plans.train import BaselineFit

    return BaselineFit("core", "1h", name, "label", FEATURES, SimpleNamespace(stages=[model]), scored)
