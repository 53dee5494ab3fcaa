"""First-order Sugeno rules with Gaussian memberships, fitted by ridge regression.

Two forms of the layers:

* SQL expressions that turn rows into (row, input, set) or (row, rule) rows, for reports;
* batch scoring and partial normal equations with NumPy on Arrow batches, for the bulk work.

The fit needs D'D and D'y only (D: rows x rules*(inputs+1)), or products with D'D for large models; see
``normal_equations``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.fixed_values import CORE_FEATURES, EPS, MIN_SIGMA, N_MFS, RIDGE_ALPHA, SEED
from gridweave.functions import kernels
from gridweave.functions.text import Expr, add, array, col, let, num, put, quote, select, struct, table
from gridweave.operators import normal_equations
from gridweave.operators.quality import DataQualityError, finite_report, raise_on_violations
from gridweave.operators.quantiles import exact_quantiles

# the executors need no installed copy of the package: the kernels are pickled by value
register_pickle_by_value(kernels)

# widest normal equations that the driver solves: 20,000 coefficients are 3.2 GB
WIDTH_LIMIT = 20_000
# limits of the exponent before exp() under- or overflows
EXP_LIMITS = (-745.0, 709.0)


# --- model ------------------------------------------------------------------------------


def rule_grid(n_mfs: int, n_inputs: int) -> np.ndarray:
    """All combinations of set numbers, the last input running fastest."""
    return np.indices((n_mfs,) * n_inputs).reshape(n_inputs, -1).T.copy()


@dataclass(frozen=True)
class FuzzyModel:
    features: tuple[str, ...] = CORE_FEATURES
    mu: np.ndarray | None = None
    sigma: np.ndarray | None = None
    rules: np.ndarray | None = None
    coefficients: np.ndarray | None = None
    ridge_alpha: float = RIDGE_ALPHA
    min_sigma: float = MIN_SIGMA
    eps: float = EPS
    seed: int = SEED
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def n_mfs(self) -> int:
        return self.mu.shape[1]

    @property
    def n_rules(self) -> int:
        return self.rules.shape[0]

    @property
    def width(self) -> int:
        return self.n_rules * (len(self.features) + 1)

    def batch_rules(self) -> kernels.Rules:
        return kernels.Rules(self.mu, self.sigma, self.rules, self.coefficients)


def default_centers(n_mfs: int) -> np.ndarray:
    return np.array([0.5]) if n_mfs == 1 else np.linspace(0.33, 0.67, n_mfs)


def center_levels(n_mfs: int) -> list[float]:
    """Quantile levels of the set centers; two sets sit on the quartiles like any other number."""
    return np.linspace(0.25, 0.75, n_mfs).tolist()


def initialize_memberships(
    train: DataFrame,
    features: tuple[str, ...] = CORE_FEATURES,
    n_mfs: int = N_MFS,
    min_sigma: float = MIN_SIGMA,
    rows: int | None = None,
) -> FuzzyModel:
    """Set centers from exact quantiles of the training rows; a handful of numbers per input."""
    levels = center_levels(n_mfs)
    quantiles = exact_quantiles(train, list(features), levels, rows=rows)
    found = {r["column"]: list(r["quantiles"]) for r in quantiles.collect()}
    if set(found) != set(features):
        raise DataQualityError(f"no values for: {sorted(set(features) - set(found))}")
    mu = np.array([found[f] for f in features], dtype=float)
    flat = mu[:, -1] - mu[:, 0] <= EPS  # always true for a single set
    mu[flat] = default_centers(n_mfs)
    half_span = (mu[:, -1] - mu[:, 0]) / 2.0
    sigma = np.maximum(half_span, min_sigma)[:, None].repeat(n_mfs, axis=1)
    return FuzzyModel(
        features=tuple(features), mu=mu, sigma=sigma, rules=rule_grid(n_mfs, len(features)), min_sigma=min_sigma
    )


# --- scoring ------------------------------------------------------------------------------


def score(df: DataFrame, model: FuzzyModel, output: str = "prediction") -> DataFrame:
    """Adds the model output. Rows with a missing or infinite input get null.

    The function travels with its parameters (rules x (inputs+1) numbers); only the input
    columns cross to Python.
    """

    rules = model.batch_rules()

    @F.pandas_udf("double")
    def predict(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(kernels.predict(columns.to_numpy(dtype=float), rules))

    inputs = F.expr(struct({f: f"double({col(f)})" for f in model.features}))
    raw = df.withColumn(output, predict(inputs))
    return put(raw, {output: f"nullif({col(output)}, double('NaN'))"})


# --- distributed fit ----------------------------------------------------------------------


def fit_consequents(
    df: DataFrame, model: FuzzyModel, targets: list[str], alpha: float | None = None, iterative: bool | None = None
) -> dict[str, FuzzyModel]:
    """One fitted model per target from the same passes.

    The direct solution has one D'D on the driver and one D'y per target. Models with more than
    ``WIDTH_LIMIT`` coefficients are solved by conjugate gradients; ``iterative`` forces either way. A missing
    or infinite input shows up in the sums, so the check costs no pass of its own.
    """
    alpha = model.ridge_alpha if alpha is None else alpha
    iterative = model.width > WIDTH_LIMIT if iterative is None else iterative
    if not iterative and model.width > WIDTH_LIMIT:
        raise DataQualityError(f"{model.width} coefficients; the direct solution takes {WIDTH_LIMIT}")
    data, rules = normal_equations.fit_input(df, list(model.features), targets), model.batch_rules()
    if iterative:
        try:
            solution = normal_equations.conjugate_gradients(data, rules, alpha, seed=model.seed)
        except DataQualityError:
            raise_on_violations(finite_report(df, [*model.features, *targets]), "fit input")
            raise
    else:
        gram, moments = normal_equations.gram_and_moments(data, rules)
        if not (np.isfinite(gram).all() and np.isfinite(moments).all()):
            raise_on_violations(finite_report(df, [*model.features, *targets]), "fit input")
            raise DataQualityError("fit input: the sums overflow")
        solution = normal_equations.solve(gram, moments.T, alpha).T
    shape = (model.n_rules, len(model.features) + 1)
    return {t: replace(model, coefficients=solution[i].reshape(shape), ridge_alpha=alpha) for i, t in enumerate(targets)}


def residuals(df: DataFrame, model: FuzzyModel, target: str) -> np.ndarray:
    """D'(y - Dc) - alpha c for every coefficient c of a fitted model: zero for the ridge solution."""
    data, rules = normal_equations.fit_input(df, list(model.features), [target]), model.batch_rules()
    c = model.coefficients.reshape(-1, 1)
    gone = normal_equations.products(data, rules, None) - normal_equations.products(data, rules, c)
    return (gone - model.ridge_alpha * c).ravel()


def split_rmse(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """RMSE, rows and unusable predictions per split from one scoring pass."""
    error = f"({col(prediction)} - {col(actual)})"
    return df.groupBy("split").agg(
        F.expr("count(*)").alias("rows"),
        F.expr(f"sqrt(avg({error} * {error}))").alias("rmse"),
        F.expr(f"count_if({col(prediction)} IS NULL)").alias("not_finite"),
    )


# --- layers as SQL expressions ---------------------------------------------------------------


def log_membership(x: Expr, mu: float, sigma: float) -> Expr:
    z = f"greatest({num(-kernels.Z_LIMIT)}, least({num(kernels.Z_LIMIT)}, ({x} - {num(mu)}) / {num(sigma)}))"
    return f"-0.5D * {z} * {z}"


def membership_rows(df: DataFrame, model: FuzzyModel, keys: list[str]) -> DataFrame:
    """(keys, input, mf, membership) rows."""
    entries = table(
        {
            "input": quote(f),
            "mf": str(j),
            "membership": f"exp({log_membership(col(f), model.mu[i, j], model.sigma[i, j])})",
        }
        for i, f in enumerate(model.features)
        for j in range(model.n_mfs)
    )
    return df.selectExpr(*keys, f"inline({entries})")


SUM = "0.0D, (total, v) -> total + v"


def rule_logs(model: FuzzyModel) -> Expr:
    """array<double>: one log strength per rule, ordered by rule number.

    The log memberships form an array of arrays; a rule is an array of set numbers.
    """
    sets = array(
        array(log_membership(col(f), m, s) for m, s in zip(model.mu[i], model.sigma[i]))
        for i, f in enumerate(model.features)
    )
    grid = array(array(str(int(j)) for j in rule) for rule in model.rules)
    strength = f"aggregate(zip_with(sets, rule, (grades, j) -> grades[j]), {SUM})"
    return let("sets", sets, f"transform({grid}, rule -> {strength})")


def rule_strengths(model: FuzzyModel) -> Expr:
    """Logs, their largest, and weights (strengths divided by their sum), all inside the row.

    Logs rank rules without the rounding ties that exponentials have.
    """
    weights = struct({"logs": "logs", "top": "top", "weights": "transform(raised, v -> v / total)"})
    summed = let("total", f"aggregate(raised, {SUM})", weights)
    raised = let("raised", "transform(logs, v -> exp(v - top))", summed)
    return let("logs", rule_logs(model), let("top", "array_max(logs)", raised))


def firing_rows(df: DataFrame, model: FuzzyModel, keys: list[str]) -> DataFrame:
    """(keys, rule, strength): product of the rule's memberships."""
    rows = df.selectExpr(*keys, f"posexplode({rule_logs(model)}) AS (rule, _log)")
    low, high = (num(v) for v in EXP_LIMITS)
    return rows.selectExpr(*keys, "rule", f"exp(greatest({low}, least({high}, _log))) AS strength")


def normalized_rows(df: DataFrame, model: FuzzyModel, keys: list[str]) -> DataFrame:
    """(keys, rule, weight) rows; the weights of a row sum to 1."""
    return df.selectExpr(*keys, f"posexplode({rule_strengths(model)}.weights) AS (rule, weight)")


def active_rules(df: DataFrame, model: FuzzyModel, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` strongest rules of every row, ranked inside the row; no shuffle."""
    entry = struct({"neg": "-v", "rule": "i", "weight": "r.weights[i]"})
    top = f"slice(array_sort(transform(r.logs, (v, i) -> {entry})), 1, {k})"
    ranked = df.selectExpr(*keys, f"posexplode({let('r', rule_strengths(model), top)}) AS (_rank, _e)")
    return ranked.selectExpr(*keys, "_rank + 1 AS rank", "_e.rule AS rule", "_e.weight AS weight")


def rule_grid_rows(spark: SparkSession, n_mfs: int, features: tuple[str, ...]) -> DataFrame:
    """(rule, one set number per input) rows: digits of the rule number in base ``n_mfs``."""
    n = len(features)
    digits = {f"mf_{f}": f"int(id div {n_mfs ** (n - 1 - i)} % {n_mfs})" for i, f in enumerate(features)}
    return spark.range(n_mfs**n).selectExpr("int(id) AS rule", *select([], digits))


def rule_usage(df: DataFrame, model: FuzzyModel) -> DataFrame:
    """Every rule of the grid with the rows it dominates and its total weight."""
    entry = struct({"weight": "w", "dominant": "int(r.logs[i] = r.top)"})
    entries = let("r", rule_strengths(model), f"transform(r.weights, (w, i) -> {entry})")
    used = df.selectExpr(f"posexplode({entries}) AS (rule, _e)").groupBy("rule").agg(
        F.expr("sum(_e.dominant)").alias("dominant_rows"), F.expr("sum(_e.weight)").alias("total_weight")
    )
    grid = rule_grid_rows(df.sparkSession, model.n_mfs, model.features)
    return grid.join(used, "rule", "left").fillna(0, ["dominant_rows", "total_weight"])


def sugeno_rows(df: DataFrame, model: FuzzyModel, keys: list[str], output: str = "prediction") -> DataFrame:
    """The whole forward pass as SQL expressions: weights times linear rule outputs."""
    inputs = array(["1.0D", *[f"double({col(f)})" for f in model.features]])
    coefficients = array(array(num(v) for v in c) for c in model.coefficients)
    outputs = f"transform({coefficients}, c -> aggregate(zip_with(c, x, (a, b) -> a * b), {SUM}))"
    terms = f"zip_with({rule_strengths(model)}.weights, {let('x', inputs, outputs)}, (w, f) -> w * f)"
    return df.selectExpr(*keys, f"aggregate({terms}, {SUM}) AS {col(output)}")


def gram_rows(df: DataFrame, model: FuzzyModel, targets: list[str]) -> DataFrame:
    """D'D (upper triangle) and D'y as (i, j, value) rows; ``j`` = -1 - k marks D'y of target k."""
    tiles = normal_equations.gram_tiles(normal_equations.fit_input(df, list(model.features), targets), model.batch_rules())
    return tiles.selectExpr("i", "j", "posexplode(values) AS (_at, value)").selectExpr(
        "CASE WHEN j < 0 THEN i + _at ELSE i END AS i", "CASE WHEN j < 0 THEN j ELSE j + _at END AS j", "value"
    )
