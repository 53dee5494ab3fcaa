"""Exact quantiles against NumPy, buffered and narrowed."""

import numpy as np
import pandas as pd
import pytest

from gridweave.operators import quantiles
from gridweave.operators.quantiles import exact_quantiles
from gridweave.operators.summary import describe, histogram, low_cardinality_columns

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 6000
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["hot", "b", "c"], n, p=[0.9, 0.09, 0.01]),
            "normal": rng.normal(size=n),
            "ties": rng.choice([0.0, 1.0, 2.0], n, p=[0.4, 0.35, 0.25]),
            "skew": rng.pareto(0.5, n) * 1e3,
            "holes": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)),
        }
    )
    clean = pdf.astype(object).where(pdf.notna(), None)
    return pdf, spark.createDataFrame(clean, "g string, normal double, ties double, skew double, holes double")


@pytest.mark.parametrize("limit", [10, 100, 10**6])
def test_whole_table(data, limit):
    pdf, df = data
    columns = ["normal", "ties", "skew", "holes"]
    got = {r["column"]: list(r["quantiles"]) for r in exact_quantiles(df, columns, LEVELS, buffer_rows=limit).collect()}
    for c in columns:
        np.testing.assert_allclose(got[c], np.quantile(pdf[c].dropna(), LEVELS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("limit", [30, 10**6])
def test_per_group(data, limit):
    pdf, df = data
    got = describe(df, ["skew", "normal"], ["g"], buffer_rows=limit).toPandas().set_index(["g", "column"])
    want = pdf.groupby("g")[["skew", "normal"]].describe()
    for g in ("hot", "b", "c"):
        for c in ("skew", "normal"):
            row = got.loc[(g, c)]
            np.testing.assert_allclose(
                row[["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].astype(float), want.loc[g, c], rtol=1e-10
            )


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, float(v)) for v in range(101)] + [("a", float(v)) for v in range(11)], "g string, v double")
    for limit in (5, 10**6):
        got = {r["g"]: (r["count"], r["p25"], r["p50"]) for r in describe(df, ["v"], ["g"], buffer_rows=limit).collect()}
        assert got == {None: (101, 25.0, 50.0), "a": (11, 2.5, 5.0)}


def test_histogram_equals_numpy(data):
    pdf, df = data
    counts, edges = np.histogram(pdf["normal"], bins=50)
    got = histogram(df, "normal").toPandas().set_index("bin")["rows"].reindex(range(50), fill_value=0)
    assert got.tolist() == counts.tolist()


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    got = histogram(df, "v", 4).first()
    counts, edges = np.histogram([3.0, 3.0], bins=4)
    assert got["rows"] == 2 and counts[got["bin"]] == 2 and got["bin_start"] == edges[got["bin"]]


def test_low_cardinality_columns(data, spark):
    df = data[1].selectExpr("*", "CAST(NULL AS INT) AS nothing", "int(normal * 2) AS many")
    assert low_cardinality_columns(df) == ["g", "nothing", "ties"]


@pytest.mark.parametrize("seed", range(3))
def test_both_paths_agree_on_infinity_and_ties(spark, seed):
    """Bit for bit, with infinite values, ties and long decimals."""
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(0, 1, 12), [np.inf, np.inf, -np.inf], np.repeat(0.1, 5), rng.integers(0, 3, 8) / 3])
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(values)], "v double")
    levels = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.97, 1.0]
    found = [exact_quantiles(df, ["v"], levels, buffer_rows=n).first()["quantiles"] for n in (1_000, 5)]
    assert list(map(repr, found[0])) == list(map(repr, found[1]))


def test_large_group_beside_small_ones(spark):
    """A group of ten times the buffer, exact, with ties and a narrow sketch margin that must be widened."""
    n = 200_000
    df = spark.range(n).selectExpr("CASE WHEN id % 10 = 0 THEN 'small' ELSE 'large' END AS g", "double(pmod(id * 7919, 100003)) / 7 AS v", "double(id % 3) AS t")
    pdf = df.toPandas()
    for margin in (quantiles.MARGIN, 1e-6):
        got = {(r["g"], r["column"]): list(r["quantiles"]) for r in _narrow(df, margin).collect()}
        for g in ("small", "large"):
            for c in ("v", "t"):
                np.testing.assert_allclose(got[g, c], np.quantile(pdf[pdf["g"] == g][c], LEVELS), rtol=1e-12)


def _narrow(df, margin):
    known = quantiles.profile(df, ["v", "t"], ["g"])
    return quantiles._narrowed(quantiles.long_values(df, ["g"], ["v", "t"]), known, ["g", "column"], LEVELS, margin)


@pytest.mark.parametrize("limit", [100, 10**6])
def test_describe_reads_its_input_twice(spark, limit):
    seen, n = spark.sparkContext.accumulator(0), 20_000

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(n).selectExpr("id % 3 AS g", "double(hash(id)) AS v").mapInArrow(counted, "g long, v double")
    assert describe(df, ["v"], ["g"], buffer_rows=limit).count() == 3
    assert seen.value == 2 * n
