"""Layers of the fuzzy model with fixed parameters, its sums, and the fitted model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.catalog.sql import d, r
from gridweave.fixed_values import CORE_FEATURES, MIN_SIGMA
from gridweave.functions.text import constant_rows, num, quote
from gridweave.operators import fuzzy
from gridweave.operators.quantiles import exact_quantiles
from gridweave.plans import train

CORE = list(CORE_FEATURES)
KEYS = ["profile_code", "datetime"]
DIGITS = 8


def fixed_model(n_mfs: int = 2) -> fuzzy.FuzzyModel:
    """Default centers, and coefficients that follow a simple rule."""
    centers = fuzzy.default_centers(n_mfs)
    sigma = max(float(centers[-1] - centers[0]) / 2.0, MIN_SIGMA)
    n = len(CORE)
    rules = fuzzy.rule_grid(n_mfs, n)
    number = np.arange(len(rules))[:, None] * 7 + np.arange(n + 1)[None, :]
    return fuzzy.FuzzyModel(
        features=CORE_FEATURES,
        mu=np.tile(centers, (n, 1)),
        sigma=np.full((n, n_mfs), sigma),
        rules=rules,
        coefficients=(number % 11 - 5) / 10.0,
    )


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return i.prepared(spark, sf).scaled("core", extra={})


def _fit_data(spark: SparkSession, sf: str, horizon: str = "1h", stored: DataFrame | None = None) -> train.FitData:
    return train.fit_data(i.prepared(spark, sf, horizon, stored), i.VALIDATION_START, i.TRAIN_END)


def membership_init(spark: SparkSession, sf: str) -> DataFrame:
    """Set centers and widths from the quartiles of the scaled training rows."""
    rows = _fit_data(spark, sf).rows.filter("split = 'train_fit'")
    model = fuzzy.initialize_memberships(rows)
    return i.rounded(
        constant_rows(
            spark,
            [
                {"input": quote(f), "mf": str(j), "mu": num(model.mu[k, j]), "sigma": num(model.sigma[k, j])}
                for k, f in enumerate(model.features)
                for j in range(model.n_mfs)
            ],
        ),
        ["mu", "sigma"],
    )


def core_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles of the raw core features, by narrowing brackets."""
    found = exact_quantiles(i.wide_table(spark, sf), CORE, [0.25, 0.75], buffer_rows=200)
    return i.rounded(found.selectExpr("`column`", "quantiles[0] AS p25", "quantiles[1] AS p75"), ["p25", "p75"])


def membership_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = fuzzy.membership_rows(_scaled(spark, sf), fixed_model(), KEYS)
    return i.rounded(rows, ["membership"], DIGITS)


def firing_strengths(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(fuzzy.firing_rows(_scaled(spark, sf), fixed_model(), KEYS), ["strength"], DIGITS)


def normalized_strengths(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(fuzzy.normalized_rows(_scaled(spark, sf), fixed_model(), KEYS), ["weight"], DIGITS)


def active_rules(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(fuzzy.active_rules(_scaled(spark, sf), fixed_model(), KEYS), ["weight"], DIGITS)


def rule_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule, the rows it dominates and its total weight."""
    return i.rounded(fuzzy.rule_usage(_scaled(spark, sf), fixed_model()), ["total_weight"])


def sugeno_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Forward pass as SQL expressions."""
    return i.rounded(fuzzy.sugeno_rows(_scaled(spark, sf), fixed_model(), KEYS), ["prediction"], DIGITS)


def sugeno_predict_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Forward pass on Arrow batches; the same numbers."""
    scored = fuzzy.score(_scaled(spark, sf), fixed_model()).select(*KEYS, "prediction")
    return i.rounded(scored, ["prediction"], DIGITS)


def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Normal-equation sums with one set per input: plain sums of products."""
    rows = _fit_data(spark, sf).rows.filter("split = 'train_fit'")
    return i.rounded(fuzzy.gram_rows(rows, fixed_model(1), ["target_1h_scaled"]), ["value"])


def gram_products(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of D'D times a fixed vector, for two and three sets: all cells of both matrices take part."""
    rows = _fit_data(spark, sf).rows.filter("split = 'train_fit'")
    frames = []
    for n_mfs in (2, 3):
        cells = fuzzy.gram_rows(rows, fixed_model(n_mfs), ["target_1h_scaled"])
        upper = cells.where("j >= i").selectExpr("i", f"value * {_weight('j')} AS t")
        lower = cells.where("j > i").selectExpr("j AS i", f"value * {_weight('i')} AS t")
        moments = cells.where("j < 0").selectExpr("i", "value AS moment")
        sums = upper.unionByName(lower).groupBy("i").agg(F.sum("t").alias("product"))
        frames.append(sums.join(moments, "i").selectExpr(f"{n_mfs} AS n_mfs", "i", "product", "moment"))
    return i.rounded(frames[0].unionByName(frames[1]), ["product", "moment"])


def _weight(index: str) -> str:
    """The fixed vector of ``gram_products``; the same text in both engines."""
    return f"((({index} * 37) % 101 - 50) / 5e1)"


def _diagnostics(data: train.FitData, model: fuzzy.FuzzyModel) -> DataFrame:
    """Rows, unusable predictions and, against the forward pass in SQL expressions, the RMSE of every split."""
    found = train.fit_diagnostics(train.score_fit_data(data, model), data.target)
    again = fuzzy.sugeno_rows(data.rows, model, ["split", f"{data.target}_scaled AS y"], "p").groupBy("split").agg(
        F.expr("pow(sum((y - p) * (y - p)) / count(*), 0.5D)").alias("_again")
    )
    return found.join(again, "split").selectExpr(
        f"'{data.horizon}' AS horizon", "split", "rows", "not_finite", "coalesce(abs(rmse - _again) < 1e-9D, false) AS rmse_agrees"
    )


def fuzzy_fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on train_fit, score every split, both horizons, each from its own rows."""
    stored = i.stored_wide(spark, sf)
    data = [_fit_data(spark, sf, h, stored) for h in ("1h", "24h")]
    models = train.fit_horizons(data)
    parts = [_diagnostics(x, models[x.horizon]) for x in data]
    return parts[0].unionByName(parts[1])


def fuzzy_fit_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Both horizons from one pass over the training rows, which keep the same rows."""
    data, models = train.fit_wide(i.stored_wide(spark, sf), i.VALIDATION_START, i.TRAIN_END)
    parts = [_diagnostics(x, models[h]) for h, x in data.items()]
    return parts[0].unionByName(parts[1])


QUERIES = {
    f.__name__: f
    for f in (
        membership_init, core_quantiles, membership_values, firing_strengths, normalized_strengths, active_rules,
        rule_grid, sugeno_predict, sugeno_predict_batch, gram_matrix, gram_products, fuzzy_fit_predict, fuzzy_fit_shared,
    )
}

_X = q.wide_plus(
    q.splits(),
    q.stats([*CORE, "target_1h"]),
    f"""x AS (SELECT profile_code, datetime, fit_split, {", ".join(f"{q.scaled(c)} AS {c}" for c in CORE)},
         {q.scaled("target_1h", 0.0, 1.25)} AS y FROM rows1, st)""",
)
_MU, _SIGMA = fixed_model().mu[0], fixed_model().sigma[0]


def _log(c: str, j: int) -> str:
    z = f"(({c} - {d(float(_MU[j]))}) / {d(float(_SIGMA[j]))})"
    return f"(-5e-1 * {z} * {z})"


# rule number -> one binary digit per input, the first input being the highest
_DIGIT = {c: f"((rule // {2 ** (5 - k)}) % 2)" for k, c in enumerate(CORE)}
_RULES = (
    _X
    + f""", grid AS (SELECT CAST(range AS INTEGER) AS rule FROM range(64)),
logs AS (SELECT profile_code, datetime, rule, {", ".join(CORE)},
  {" + ".join(f"CASE {_DIGIT[c]} WHEN 0 THEN {_log(c, 0)} ELSE {_log(c, 1)} END" for c in CORE)} AS l FROM x, grid),
weights AS (SELECT *, exp(l - max(l) OVER w) / sum(exp(l - top)) OVER w AS weight
  FROM (SELECT *, max(l) OVER (PARTITION BY profile_code, datetime) AS top FROM logs)
  WINDOW w AS (PARTITION BY profile_code, datetime))
"""
)
_OUTPUT = " + ".join(
    f"(((rule * 7 + {t}) % 11) - 5) / 1e1 * {'1e0' if t == 0 else CORE[t - 1]}" for t in range(len(CORE) + 1)
)
_PREDICT = (
    _RULES
    + f"SELECT profile_code, datetime, {r(f'sum(weight * ({_OUTPUT}))', DIGITS)} AS prediction FROM weights GROUP BY 1, 2"
)
_TERMS = ["1e0", *CORE]


def _log_of(c: str, n_mfs: int) -> str:
    """Log membership of the set that the rule's digit names, for any number of sets."""
    model = fixed_model(n_mfs)
    digit = f"((rule // {n_mfs ** (5 - CORE.index(c))}) % {n_mfs})"
    z = f"(({c} - CASE {digit} {' '.join(f'WHEN {j} THEN {d(float(m))}' for j, m in enumerate(model.mu[0]))} END) / {d(float(model.sigma[0][0]))})"
    return f"(-5e-1 * {z} * {z})"


def _products(n_mfs: int) -> str:
    """D (D v) row by row: the rows' D v first, then the sums over the rows."""
    terms = [f"sum(weight * {t} * dv) AS p{k}, sum(weight * {t} * y) AS m{k}" for k, t in enumerate(_TERMS)]
    own = " + ".join(f"{_weight(f'(rule * {len(_TERMS)} + {k})')} * {t}" for k, t in enumerate(_TERMS))
    return f"""
l{n_mfs} AS (SELECT x.*, rule, {" + ".join(_log_of(c, n_mfs) for c in CORE)} AS l FROM x, range({n_mfs ** len(CORE)}) g(rule) WHERE fit_split = 'train_fit'),
w{n_mfs} AS (SELECT *, exp(l - top) / sum(exp(l - top)) OVER w AS weight
  FROM (SELECT *, max(l) OVER (PARTITION BY profile_code, datetime) AS top FROM l{n_mfs}) WINDOW w AS (PARTITION BY profile_code, datetime)),
v{n_mfs} AS (SELECT *, sum(weight * ({own})) OVER (PARTITION BY profile_code, datetime) AS dv FROM w{n_mfs}),
s{n_mfs} AS (SELECT rule, {", ".join(terms)} FROM v{n_mfs} GROUP BY rule)"""

ORACLE = {
    "membership_init": _X
    + f""", qs AS ({" UNION ALL ".join(f"SELECT '{c}' AS input, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM x WHERE fit_split = 'train_fit'" for c in CORE)})
SELECT input, 0 AS mf, {r("CASE WHEN b - a <= 1e-12 THEN 33e-2 ELSE a END")} AS mu,
       {r("greatest(CASE WHEN b - a <= 1e-12 THEN 34e-2 ELSE b - a END / 2, 1e-1)")} AS sigma FROM qs
UNION ALL SELECT input, 1, {r("CASE WHEN b - a <= 1e-12 THEN 67e-2 ELSE b END")},
       {r("greatest(CASE WHEN b - a <= 1e-12 THEN 34e-2 ELSE b - a END / 2, 1e-1)")} FROM qs""",
    "core_quantiles": q.WIDE
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f"quantile_cont({c}, 0.25)")} AS p25, {r(f"quantile_cont({c}, 0.75)")} AS p75 FROM wide"""
        for c in CORE
    ),
    "membership_values": _X
    + " UNION ALL ".join(
        f"SELECT profile_code, datetime, '{c}' AS input, {j} AS mf, {r(f'exp({_log(c, j)})', DIGITS)} AS membership FROM x"
        for c in CORE
        for j in (0, 1)
    ),
    "firing_strengths": _RULES + f"SELECT profile_code, datetime, rule, {r('exp(l)', DIGITS)} AS strength FROM logs",
    "normalized_strengths": _RULES + f"SELECT profile_code, datetime, rule, {r('weight', DIGITS)} AS weight FROM weights",
    "active_rules": _RULES
    + f"""SELECT profile_code, datetime, rank, rule, {r('weight', DIGITS)} AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_code, datetime ORDER BY l DESC, rule) AS rank FROM weights) WHERE rank <= 3""",
    "rule_grid": _RULES
    + f"""SELECT rule, {", ".join(f"CAST({_DIGIT[c]} AS INTEGER) AS mf_{c}" for c in CORE)},
  count(*) FILTER (WHERE l = top) AS dominant_rows, {r("sum(weight)")} AS total_weight FROM weights GROUP BY rule""",
    "sugeno_predict": _PREDICT,
    "sugeno_predict_batch": _PREDICT,
    "gram_matrix": _X
    + " UNION ALL ".join(
        [
            f"SELECT {a} AS i, {b} AS j, {r(f'sum({_TERMS[a]} * {_TERMS[b]})')} AS value FROM x WHERE fit_split = 'train_fit'"
            for a in range(7)
            for b in range(a, 7)
        ]
        + [f"SELECT {a} AS i, -1 AS j, {r(f'sum({_TERMS[a]} * y)')} AS value FROM x WHERE fit_split = 'train_fit'" for a in range(7)]
    ),
    "gram_products": _X + ", " + ",".join(_products(n) for n in (2, 3)) + " " + " UNION ALL ".join(
        f"SELECT {n} AS n_mfs, rule * {len(_TERMS)} + {k} AS i, {r(f'p{k}')} AS product, {r(f'm{k}')} AS moment FROM s{n}"
        for n in (2, 3)
        for k in range(len(_TERMS))
    ),
    **dict.fromkeys(
        ("fuzzy_fit_predict", "fuzzy_fit_shared"),
        _X + """SELECT horizon, fit_split AS split, count(*) AS rows, CAST(0 AS BIGINT) AS not_finite, true AS rmse_agrees
       FROM x, (VALUES ('1h'), ('24h')) h(horizon) GROUP BY 1, 2""",
    ),
}
