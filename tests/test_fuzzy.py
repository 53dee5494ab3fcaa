"""The fuzzy model against a direct NumPy computation of its formulas."""

import itertools

import numpy as np
import pandas as pd
import pytest

from gridweave.operators import fuzzy, normal_equations
from gridweave.operators.quality import DataQualityError
from gridweave.sources.models import load_model, save_model

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    y = 0.2 + x @ [0.1, -0.05, 0.3] + 0.05 * np.sin(6 * x[:, 0]) + rng.normal(0, 0.01, 500)
    pdf = pd.DataFrame(x, columns=FEATURES).assign(y=y, z=2 * y - 1, id=range(500))
    return x, y, spark.createDataFrame(pdf)


def direct(x, mu, sigma):
    """Strengths and weights, rule by rule."""
    rules = list(itertools.product(range(mu.shape[1]), repeat=mu.shape[0]))
    strength = np.array(
        [[np.prod([np.exp(-0.5 * ((row[i] - mu[i, j]) / sigma[i, j]) ** 2) for i, j in enumerate(r)]) for r in rules] for row in x]
    )
    return strength, strength / strength.sum(axis=1, keepdims=True)


def direct_design(x, weights):
    basis = np.column_stack([np.ones(len(x)), x])
    return np.concatenate([weights[:, [r]] * basis for r in range(weights.shape[1])], axis=1)


def collect(df, name):
    rows = df.toPandas().sort_values(["id", "rule"])
    return rows[name].to_numpy().reshape(500, -1)


@pytest.mark.parametrize("n_mfs", [1, 2, 3])
def test_fit_equals_direct_solution(data, n_mfs):
    x, y, df = data
    start = fuzzy.initialize_memberships(df, FEATURES, n_mfs)
    if n_mfs > 1:
        np.testing.assert_allclose(start.mu, np.quantile(x, np.linspace(0.25, 0.75, n_mfs), axis=0).T)
        half = (start.mu[:, -1] - start.mu[:, 0]) / 2
        np.testing.assert_allclose(start.sigma, np.maximum(half, 0.1)[:, None].repeat(n_mfs, 1))
    else:
        assert (start.mu == 0.5).all() and (start.sigma == 0.1).all()
    model = fuzzy.fit_consequents(df, start, ["y"], 1e-3)["y"]
    d = direct_design(x, direct(x, start.mu, start.sigma)[1])
    flat = np.linalg.solve(d.T @ d + 1e-3 * np.eye(d.shape[1]), d.T @ y)
    got = fuzzy.score(df, model).toPandas().sort_values("id")["prediction"]
    np.testing.assert_allclose(got, d @ flat, atol=1e-9)


def test_one_set_is_plain_ridge(data):
    x, y, df = data
    start = fuzzy.initialize_memberships(df, FEATURES, 1)
    model = fuzzy.fit_consequents(df, start, ["y"], 0.5)["y"]
    b = np.column_stack([np.ones(len(x)), x])
    np.testing.assert_allclose(model.coefficients[0], np.linalg.solve(b.T @ b + 0.5 * np.eye(4), b.T @ y), rtol=1e-9)


def test_partitions_do_not_matter(data):
    _, _, df = data
    start = fuzzy.initialize_memberships(df, FEATURES)
    reference = None
    for n in (1, 3, 7):
        model = fuzzy.fit_consequents(df.repartition(n), start, ["y"])["y"]
        scores = fuzzy.score(df, model).toPandas().sort_values("id")["prediction"].to_numpy()
        reference = scores if reference is None else reference
        np.testing.assert_allclose(scores, reference, atol=1e-9)


def test_two_targets_share_one_pass(data):
    _, _, df = data
    start = fuzzy.initialize_memberships(df, FEATURES)
    both = fuzzy.fit_consequents(df, start, ["y", "z"])
    for t in ("y", "z"):
        alone = fuzzy.fit_consequents(df, start, [t])[t]
        np.testing.assert_allclose(both[t].coefficients, alone.coefficients, atol=1e-8)


def test_layers(data):
    x, _, df = data
    model = fuzzy.initialize_memberships(df, FEATURES)
    strength, weights = direct(x, model.mu, model.sigma)
    np.testing.assert_allclose(collect(fuzzy.firing_rows(df, model, ["id"]), "strength"), strength, rtol=1e-9)
    got = collect(fuzzy.normalized_rows(df, model, ["id"]), "weight")
    np.testing.assert_allclose(got, weights, rtol=1e-9)
    np.testing.assert_allclose(got.sum(axis=1), 1.0)
    top = fuzzy.active_rules(df, model, ["id"], 2).toPandas().sort_values(["id", "rank"])
    order = np.argsort(-weights, axis=1, kind="stable")[:, :2]
    assert (top["rule"].to_numpy().reshape(500, 2) == order).all()


def test_weights_survive_far_inputs(spark):
    df = spark.createDataFrame([(1, 1e4, -1e4, 0.0)], "id int, a double, b double, c double")
    model = fuzzy.FuzzyModel(
        FEATURES, np.tile([0.3, 0.7], (3, 1)), np.full((3, 2), 0.1), fuzzy.rule_grid(2, 3), np.ones((8, 4))
    )
    total = fuzzy.normalized_rows(df, model, ["id"]).agg({"weight": "sum"}).first()[0]
    assert total == pytest.approx(1.0)
    assert np.isfinite(fuzzy.score(df, model).first()["prediction"])


def test_sql_and_batch_scores_agree(data):
    _, _, df = data
    model = fuzzy.fit_consequents(df, fuzzy.initialize_memberships(df, FEATURES), ["y"])["y"]
    a = fuzzy.sugeno_rows(df, model, ["id"]).toPandas().sort_values("id")["prediction"]
    b = fuzzy.score(df, model).toPandas().sort_values("id")["prediction"]
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_rule_grid_rows_last_input_fastest(spark):
    rows = fuzzy.rule_grid_rows(spark, 3, FEATURES).orderBy("rule").collect()
    assert [tuple(r)[1:] for r in rows] == list(itertools.product(range(3), repeat=3))
    assert fuzzy.rule_grid(3, 3).tolist() == [list(t) for t in itertools.product(range(3), repeat=3)]


def test_constant_input_falls_back_to_default_centers(spark):
    df = spark.createDataFrame([(float(v), 0.4, v / 10) for v in range(10)], "a double, b double, c double")
    model = fuzzy.initialize_memberships(df, FEATURES)
    assert model.mu[1].tolist() == [0.33, 0.67] and model.sigma[1, 0] == pytest.approx(0.17)


def test_missing_inputs_score_null_and_fail_the_fit(spark, data):
    _, _, df = data
    model = fuzzy.fit_consequents(df, fuzzy.initialize_memberships(df, FEATURES), ["y"])["y"]
    bad = spark.createDataFrame([(None, 0.1, 0.2, 1.0), (float("inf"), 0.1, 0.2, 1.0), (0.5, 0.5, 0.5, 1.0)], "a double, b double, c double, y double")
    scores = [r["prediction"] for r in fuzzy.score(bad, model).collect()]
    assert scores[:2] == [None, None] and scores[2] is not None
    with pytest.raises(DataQualityError, match=r"not_finite\(a\)=2"):
        fuzzy.fit_consequents(bad, model, ["y"])
    with pytest.raises(DataQualityError, match="no rows"):
        fuzzy.fit_consequents(bad.filter("false"), model, ["y"])


def test_singular_system_uses_least_squares(spark):
    rows = [(float(v), float(v), 1.0, 2.0 * v) for v in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = fuzzy.fit_consequents(df, fuzzy.initialize_memberships(df, FEATURES, 1), ["y"], 0.0)["y"]
    got = fuzzy.score(df, model).toPandas()
    np.testing.assert_allclose(got["prediction"], got["y"], atol=1e-6)


def test_save_and_load(spark, data, tmp_path):
    _, _, df = data
    model = fuzzy.fit_consequents(df, fuzzy.initialize_memberships(df, FEATURES), ["y"])["y"]
    from dataclasses import replace

    model = replace(model, metadata={"horizon": "1h"})
    save_model(spark, model, str(tmp_path), "m")
    save_model(spark, model, str(tmp_path), "m")  # overwrites
    loaded = load_model(spark, str(tmp_path), "m")
    for name in ("mu", "sigma", "rules", "coefficients"):
        np.testing.assert_array_equal(getattr(loaded, name), getattr(model, name))
    assert loaded.features == FEATURES and loaded.metadata["horizon"] == "1h" and loaded.ridge_alpha == model.ridge_alpha
    with pytest.raises(DataQualityError, match="no table"):
        load_model(spark, str(tmp_path), "other")


# --- sums and solutions ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def wide(spark):
    """A model with 405 coefficients and rows for it."""
    x = np.random.default_rng(8).random((300, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=x.sum(axis=1), z=np.sin(5 * x[:, 0]) - x[:, 1] ** 2)).repartition(5)
    start = fuzzy.initialize_memberships(df, tuple("abcd"), 3)
    return df, start, direct_design(x, direct(x, start.mu, start.sigma)[1]), x


@pytest.mark.parametrize(("tasks", "bytes_of_a_row"), [(1, 1), (6, 1), (64, 1), (5, 10**7), (7, 50_000)])
def test_every_layout_gives_the_same_sums(wide, monkeypatch, tasks, bytes_of_a_row):
    df, start, d, x = wide
    monkeypatch.setattr(normal_equations.FitInput, "tasks", tasks)
    monkeypatch.setattr(normal_equations.FitInput, "row_bytes", bytes_of_a_row)
    data = normal_equations.fit_input(df, list(start.features), ["y", "z"])
    gram, moments = normal_equations.gram_and_moments(data, start.batch_rules())
    y = np.column_stack([x.sum(axis=1), np.sin(5 * x[:, 0]) - x[:, 1] ** 2])
    np.testing.assert_allclose(gram, d.T @ d, atol=1e-9)
    np.testing.assert_allclose(moments, y.T @ d, atol=1e-9)
    v = np.random.default_rng(1).normal(size=(start.width, 37))
    np.testing.assert_allclose(normal_equations.products(data, start.batch_rules(), v), d.T @ (d @ v), atol=1e-8)
    np.testing.assert_allclose(normal_equations.products(data, start.batch_rules(), None), d.T @ y, atol=1e-9)


def test_layout_weighs_rows_against_matrices():
    few = normal_equations.layout(64, 10**8, 10**4, 90, True)
    many = normal_equations.layout(64, 10**8, 10**12, 90, True)
    assert few.groups == 1 and few.panels * (few.panels + 1) // 2 >= 64
    assert (many.groups, many.panels) == (64, 1)
    for rows in (10**4, 10**6, 10**8, 10**10, 10**12):
        found = normal_equations.layout(10_000, 10**8, rows, 90, True)
        # tasks times the matrix, or the geometric middle of rows and matrices, whichever is less
        assert found.moved <= 1.1 * min(10_000 * 10**8 + rows, 4 * (10_000 * 10**8 * rows) ** 0.5 + rows)


def shuffled(spark) -> int:
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_shuffle_grows_with_the_matrix_not_with_the_tasks(spark, wide, monkeypatch):
    df, start, _, _ = wide
    monkeypatch.setattr(normal_equations.FitInput, "tasks", 64)
    data = normal_equations.fit_input(df, list(start.features), ["y"])
    before = shuffled(spark)
    normal_equations.gram_and_moments(data, start.batch_rules())
    moved = shuffled(spark) - before
    assert 0 < moved < 4 * start.width**2 * np.log2(64)


@pytest.mark.parametrize("sketch", [20, 400])
def test_iterative_solution_equals_the_direct_one(wide, sketch):
    df, start, d, x = wide
    data = normal_equations.fit_input(df, list(start.features), ["y", "z"])
    found = normal_equations.conjugate_gradients(data, start.batch_rules(), 1e-3, sketch)
    y = np.column_stack([x.sum(axis=1), np.sin(5 * x[:, 0]) - x[:, 1] ** 2])
    wanted = np.linalg.solve(d.T @ d + 1e-3 * np.eye(start.width), d.T @ y).T
    np.testing.assert_allclose(found @ d.T, wanted @ d.T, atol=1e-6)


def test_iterative_fit_through_the_model(data, wide):
    df, start, _, _ = wide
    one, two = (fuzzy.fit_consequents(df, start, ["y"], 1e-3, iterative)["y"] for iterative in (True, False))
    a, b = (fuzzy.score(df, m).toPandas()["prediction"] for m in (one, two))
    np.testing.assert_allclose(a, b, atol=1e-6)


def test_iterative_fit_stops_on_missing_inputs(spark, wide):
    _, start, _, _ = wide
    bad = spark.createDataFrame([(None, 0.1, 0.2, 1.0, 1.0), (0.5, 0.5, 0.5, 1.0, 1.0)], "a double, b double, c double, d double, y double")
    with pytest.raises(DataQualityError, match=r"not_finite\(a\)=1"):
        fuzzy.fit_consequents(bad, start, ["y"], iterative=True)


def test_direct_solution_has_a_limit(wide, monkeypatch):
    df, start, _, _ = wide
    monkeypatch.setattr(fuzzy, "WIDTH_LIMIT", 100)
    with pytest.raises(DataQualityError, match="405 coefficients"):
        fuzzy.fit_consequents(df, start, ["y"], iterative=False)
    assert np.isfinite(fuzzy.fit_consequents(df, start, ["y"], 1e-3)["y"].coefficients).all()
