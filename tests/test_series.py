"""Row-position windows, gap filling and duplicates against pandas."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from gridweave.operators.dedup import duplicate_count, keep_first
from gridweave.operators.gapfill import dense_grid, interpolate
from gridweave.operators.series import Series, add_lag_block, first_rows, first_series, rows_bound, with_positions

SCHEMA = "series_id string, datetime timestamp_ntz, load_kwh double"
NAMES = ["load_lag_1", "load_lag_24", "target_1h", "target_24h", "load_rolling_3", "load_rolling_24"]


def make(rng, sizes: dict[str, int], missing: float = 0.0) -> pd.DataFrame:
    """Hourly series with holes in the clock (rows left out) and, if asked, null values."""
    frames = []
    for name, n in sizes.items():
        hours = np.sort(rng.choice(n * 3, size=n, replace=False))
        load = np.round(rng.gamma(2.0, 30.0, n), 2)
        if missing:
            load[rng.random(n) < missing] = np.nan
        frames.append(
            pd.DataFrame({"series_id": name, "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"), "load_kwh": load})
        )
    return pd.concat(frames, ignore_index=True)


def frame(spark, pdf):
    clean = pdf.astype({"load_kwh": object}).where(pdf.notna(), None)
    return spark.createDataFrame(clean.sample(frac=1, random_state=1), SCHEMA)


def expected_lags(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.sort_values(["series_id", "datetime"]).copy()
    load = out.groupby("series_id")["load_kwh"]
    out["load_lag_1"], out["load_lag_24"] = load.shift(1), load.shift(24)
    out["target_1h"], out["target_24h"] = load.shift(-1), load.shift(-24)
    for n in (3, 24):
        out[f"load_rolling_{n}"] = load.transform(lambda s, n=n: s.shift(1).rolling(n).mean())
    return out


def read(df) -> pd.DataFrame:
    out = df.toPandas().sort_values(["series_id", "datetime"]).reset_index(drop=True)
    return out.astype({"datetime": "datetime64[ns]"})


@pytest.mark.parametrize("mode", ["bounded", "chunks"])
@pytest.mark.parametrize("missing", [0.0, 0.05])
def test_lag_block_equals_pandas(spark, mode, missing):
    pdf = make(np.random.default_rng(5), {"a": 900, "b": 60, "c": 23, "d": 1}, missing)
    sizes = {"bound": 3000} if mode == "bounded" else {"chunk_rows": 32}
    got = read(add_lag_block(frame(spark, pdf), Series(), **sizes))
    want = expected_lags(pdf).dropna(subset=NAMES).reset_index(drop=True).astype({"datetime": "datetime64[ns]"})
    assert len(got) == len(want) and set(got["series_id"]) == {"a", "b"}
    assert (got["datetime"] == want["datetime"]).all()
    for c in NAMES:
        # half-even on exact sums may differ from float sums by one unit in the last place
        np.testing.assert_allclose(got[c], want[c], atol=1.01e-4, rtol=0)


def test_both_window_forms_agree_exactly(spark):
    df = frame(spark, make(np.random.default_rng(7), {"hot": 2000, "x": 40, "y": 30}))
    plain = read(add_lag_block(df, Series(), bound=6000, drop_incomplete=False))
    for chunk_rows in (25, 64, 1000):
        chunked = read(add_lag_block(df, Series(), drop_incomplete=False, chunk_rows=chunk_rows))
        pd.testing.assert_frame_equal(chunked[plain.columns], plain)


def test_a_missing_key_is_a_series_of_its_own(spark):
    pdf = make(np.random.default_rng(8), {"a": 200, "b": 90})
    pdf.loc[pdf["series_id"] == "b", "series_id"] = None
    df = frame(spark, pdf)
    plain = read(add_lag_block(df, Series(), bound=6000))
    chunked = read(add_lag_block(df, Series(), chunk_rows=32))
    assert plain["series_id"].isna().sum() == 90 - 48
    pd.testing.assert_frame_equal(chunked[plain.columns], plain)
    filled = read(interpolate(df, Series(), ["load_kwh"], bucket_steps=16))
    assert len(filled) == 290


def test_one_hot_series_is_split_over_tasks(spark):
    """No chunk exceeds its size plus the copied edges, whatever the series length."""
    from gridweave.operators.series import with_chunks

    df = frame(spark, make(np.random.default_rng(9), {"hot": 3000, "x": 10}))
    chunks = with_chunks(with_positions(df, Series(), 128), 24, 24, 100)
    biggest = chunks.groupBy("series_id", "_chunk").count().agg({"count": "max"}).first()[0]
    assert biggest <= 148
    assert chunks.filter("_own").count() == 3010


def test_positions_count_rows(spark):
    pdf = make(np.random.default_rng(3), {"a": 500, "b": 77})
    got = read(with_positions(frame(spark, pdf), Series(), 16))
    assert (got["_pos"] == got.groupby("series_id").cumcount()).all()


def test_rows_bound_is_the_calendar(spark):
    pdf = make(np.random.default_rng(3), {"a": 50})
    hours = (pdf["datetime"].max() - pdf["datetime"].min()) / pd.Timedelta("1h") + 1
    assert rows_bound(frame(spark, pdf), "datetime") == hours


def gappy(rng) -> pd.DataFrame:
    pdf = make(rng, {"a": 300, "b": 40, "c": 20, "one": 1})
    load = pdf["load_kwh"].to_numpy()
    load[rng.random(len(load)) < 0.4] = np.nan
    a = pdf["series_id"] == "a"
    load[np.flatnonzero(a)[:30]] = np.nan  # start
    load[np.flatnonzero(a)[100:180]] = np.nan  # middle, longer than a bucket
    load[np.flatnonzero(a)[-25:]] = np.nan  # end
    load[np.flatnonzero(pdf["series_id"] == "c")] = np.nan  # nothing known
    pdf["load_kwh"] = load
    return pdf


@pytest.mark.parametrize("mode", [{"bound": 1000}, {"bucket_steps": 16}, {"bucket_steps": 100}])
def test_interpolation_equals_pandas(spark, mode):
    pdf = gappy(np.random.default_rng(11))
    got = read(interpolate(frame(spark, pdf), Series(), ["load_kwh"], **mode))
    want = pdf.sort_values(["series_id", "datetime"]).reset_index(drop=True)
    filled = want.groupby("series_id")["load_kwh"].transform(lambda s: s.interpolate(limit_direction="both"))
    np.testing.assert_allclose(got["load_kwh"], filled, rtol=1e-12)
    known = want["load_kwh"].notna()
    assert (got["load_kwh"][known] == want["load_kwh"][known]).all()


def test_first_rows_and_first_series(spark):
    pdf = make(np.random.default_rng(2), {"a": 30, "b": 5})
    df = frame(spark, pdf)
    got = read(first_rows(df, Series(), 7))
    want = pdf.sort_values(["series_id", "datetime"]).groupby("series_id").head(7).reset_index(drop=True)
    assert len(got) == 12 and (got["datetime"] == want["datetime"]).all()
    assert first_series(df, Series()).first()["series_id"] == "a"


def test_keep_first_breaks_ties_by_value(spark):
    rows = [("a", 1, 5.0), ("a", 1, 3.0), ("a", 2, 1.0), ("b", 1, None), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, t int, v double")
    got = {(r["series_id"], r["t"]): r["v"] for r in keep_first(df, ["series_id", "t"], ["v"]).collect()}
    assert got == {("a", 1): 3.0, ("a", 2): 1.0, ("b", 1): 2.0}


def test_keep_first_prefers_readings(spark):
    nan = float("nan")
    rows = [(1, None, 7.0), (1, nan, 1.0), (1, 5.0, None), (2, None, 2.0), (2, nan, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double, w double")
    got = {r["k"]: (r["v"], r["w"]) for r in keep_first(df, ["k"], []).collect()}
    assert got == {1: (5.0, None), 2: (None, 1.0)}


@pytest.mark.parametrize("bound", [9_000, None])
def test_lag_beyond_a_chunk(spark, bound):
    """A yearly lag of hourly rows: longer than a chunk of rows."""
    hours = spark.range(9_000).selectExpr("'a' AS series_id", "TIMESTAMP_NTZ'2023-01-01' + make_interval(0, 0, 0, 0, id) AS datetime", "double(id) AS load_kwh")
    got = add_lag_block(hours, Series(), lags={"l": 8_760}, leads={}, rolling={}, bound=bound)
    assert got.selectExpr("count(*)", "min(load_kwh - l)", "max(load_kwh - l)").first() == (240, 8_760.0, 8_760.0)


def test_nan_is_a_gap(spark):
    rows = [("a", datetime(2024, 1, 1, h), v) for h, v in enumerate([1.0, float("nan"), 3.0, None, 5.0])]
    df = spark.createDataFrame(rows, "series_id string, datetime timestamp_ntz, load_kwh double")
    for mode in ({"bound": 10}, {"bucket_steps": 2}):
        got = interpolate(df, Series(), ["load_kwh"], **mode).orderBy("datetime").collect()
        assert [r["load_kwh"] for r in got] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_grid_spans_each_series(spark):
    rows = [("a", datetime(2024, 1, 1, h), 1.0) for h in (0, 3)] + [("b", datetime(2024, 6, 1, h), 1.0) for h in (5, 6)]
    df = spark.createDataFrame(rows, "series_id string, datetime timestamp_ntz, load_kwh double")
    got = dense_grid(df, Series()).groupBy("series_id").count().collect()
    assert {r["series_id"]: r["count"] for r in got} == {"a": 4, "b": 2}


def test_duplicate_count(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (2, None), (3, "z")], "a int, b string")
    assert duplicate_count(df).first()["duplicate_rows"] == 3
