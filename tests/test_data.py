"""Scaling, splits, quality checks, payloads and files."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException

from conftest import CORE
from gridweave.functions.text import add, put
from gridweave.operators.quality import (
    DataQualityError,
    quality_checks,
    raise_on_violations,
    raw_scaled_parity,
    remove_invalid_rows,
    removed_row_count,
    require_columns,
    stats_coverage,
)
from gridweave.operators.scaling import ColumnStats, collect_stats, minmax_stats, scaled, scaled_target, stats_table, unscaled
from gridweave.operators.splits import add_fit_split, add_split, require_splits
from gridweave.plans import panel, preprocess, train
from gridweave.sources import files
from gridweave.sources.payload import explode_payload

KEYS = ["datetime", "profile_code", "profile_name"]


def test_constant_column_has_range_one_and_scales_to_zero(spark):
    df = spark.createDataFrame([(4.0, 1.0), (4.0, 3.0), (4.0, None)], "k double, v double")
    stats = collect_stats(minmax_stats(df, ["k", "v"]))
    assert stats == {"k": ColumnStats(4.0, 4.0, 1.0), "v": ColumnStats(1.0, 3.0, 2.0)}
    rows = df.selectExpr(f"{scaled('k', stats)} AS k", f"{scaled('v', stats)} AS v").collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (0.0, 1.0), (0.0, None)]


def test_values_outside_the_training_range_are_clipped(spark):
    stats = {"v": ColumnStats(0.0, 10.0, 10.0)}
    df = spark.createDataFrame([(-100.0,), (-1.0,), (5.0,), (12.0,), (100.0,)], "v double")
    rows = df.selectExpr(f"{scaled('v', stats)} AS f", f"{scaled_target('v', stats)} AS t").collect()
    assert [r["f"] for r in rows] == [-0.25, -0.1, 0.5, 1.2, 1.25]
    assert [r["t"] for r in rows] == [0.0, 0.0, 0.5, 1.2, 1.25]


def test_inverse_scaling(spark):
    stats = {"load_kwh": ColumnStats(100.0, 200.0, 100.0)}
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "s double")
    assert [r[0] for r in df.selectExpr(unscaled("s", "load_kwh", stats)).collect()] == [100.0, 150.0, 200.0]
    with pytest.raises(DataQualityError, match="missing scaler statistics"):
        unscaled("s", "other", stats)


def test_scaling_there_and_back(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(50, 20, 300)], "v double")
    stats = collect_stats(minmax_stats(df, ["v"]))
    gap = df.selectExpr(f"max(abs({unscaled(scaled('v', stats), 'v', stats)} - v))").first()[0]
    assert gap < 1e-10


def test_split_rows(processed, table, part_rows):
    _, scaled_rows, _ = processed
    assert require_splits(add_fit_split(scaled_rows), ("train_fit", "validation", "test")) == dict(
        zip(("train_fit", "validation", "test"), part_rows)
    )
    first_test = add_split(scaled_rows).filter("split = 'test'").selectExpr("min(datetime)").first()[0]
    assert first_test == table["datetime"][table["datetime"] >= "2025-01-01"].min()
    with pytest.raises(DataQualityError, match="empty split: test"):
        require_splits(add_split(scaled_rows.filter("datetime < TIMESTAMP_NTZ'2025-01-01'")), ("train", "test"))


def test_missing_columns_are_named(processed):
    raw, _, _ = processed
    with pytest.raises(DataQualityError, match=r"raw data is missing required columns: \['nope'\]"):
        require_columns(raw, ["humidity", "nope"], "raw data")


def test_quality_checks_find_every_kind(spark):
    rows = [("1.5", 2.0, "2024-01-01 00:00:00"), ("x", -1.0, "soon"), ("Infinity", float("nan"), "2024-01-01 01:00:00"), (None, float("inf"), None)]
    df = spark.createDataFrame(rows, "f string, t double, at string")
    report = quality_checks(df, ["f"], ["t"], "at")
    assert {(r["check"], r["column"]): r["violations"] for r in report.collect()} == {
        ("missing_or_non_numeric", "f"): 2,
        ("infinite", "f"): 1,
        ("missing_or_non_numeric", "t"): 1,
        ("infinite", "t"): 1,
        ("negative", "t"): 1,
        ("invalid_time", "at"): 2,
    }
    with pytest.raises(DataQualityError, match=r"negative\(t\)=1"):
        raise_on_violations(report, "rows")


def at_hour(table, hour):
    return int((table["datetime"].dt.hour == hour).sum())


def test_parity(processed, table):
    raw, scaled_rows, _ = processed
    row = raw_scaled_parity(raw, scaled_rows, KEYS, "load_kwh").first()
    n = len(table)
    assert row.asDict() == {"raw_rows": n, "scaled_rows": n, "key_mismatches": 0, "target_mismatches": 0, "repeated_keys": 0}
    moved = put(scaled_rows, {"load_kwh": "load_kwh + CASE WHEN hour(datetime) = 3 THEN 1e-7D ELSE 1e-9D END"})
    twice = moved.unionByName(moved.filter("hour(datetime) = 4"))
    row = raw_scaled_parity(raw, twice.filter("hour(datetime) <> 5"), KEYS, "load_kwh").first()
    assert row["target_mismatches"] == at_hour(table, 3)
    assert row["key_mismatches"] == at_hour(table, 4) + at_hour(table, 5)
    assert row["repeated_keys"] == at_hour(table, 4)


def test_stats_coverage(spark, processed):
    _, _, stats = processed
    assert stats_coverage(spark, stats_table(spark, stats), CORE).count() == 0
    broken = {**stats, "humidity": ColumnStats(1.0, 1.0, 0.0)}
    del broken["hour_sin"]
    got = {tuple(r) for r in stats_coverage(spark, stats_table(spark, broken), CORE).collect()}
    assert got == {("hour_sin", "missing"), ("humidity", "bad_range")}


def test_files_to_fit_data_rejects_bad_input(processed, table):
    raw, scaled_rows, stats = processed

    def load(r=raw, s=scaled_rows, st=stats):
        return train.fit_data_from_files(s, r, st, "1h", "load_kwh")

    assert load().rows.count() == len(table)
    with pytest.raises(DataQualityError, match="scaled data is missing required columns"):
        load(s=scaled_rows.drop("humidity"))
    with pytest.raises(DataQualityError, match=r"negative\(load_kwh\)"):
        load(r=put(raw, {"load_kwh": "load_kwh - 1000"}))
    with pytest.raises(DataQualityError, match=rf"invalid_time\(datetime\)={at_hour(table, 2)}"):
        load(s=put(scaled_rows, {"datetime": "CASE WHEN hour(datetime) <> 2 THEN datetime END"}))
    with pytest.raises(DataQualityError, match="do not match"):
        load(r=raw.filter("hour(datetime) <> 1"))
    with pytest.raises(DataQualityError, match="scaler statistics"):
        load(st={k: v for k, v in stats.items() if k != "humidity"})


def test_payload_without_hours_fails(spark):
    df = spark.createDataFrame([('{"reason": "quota"}',)], "payload string")
    with pytest.raises(PySparkException, match="no hourly data"):
        explode_payload(df).collect()


def test_payload_rows_and_nulls(spark):
    text = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, null], "rain": [0, 2]}}'
    rows = explode_payload(spark.createDataFrame([(text,)], "payload string")).orderBy("datetime").collect()
    assert [(r["datetime"], r["temperature"], r["rain"], r["humidity"]) for r in rows] == [
        (datetime(2024, 1, 1, 0), 1.5, 0.0, None),
        (datetime(2024, 1, 1, 1), None, 2.0, None),
    ]


def test_csv_with_byte_order_mark_and_bad_rows(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes("﻿datetime,load_kwh\n2024-01-01 00:00:00,1.5\n2024-01-01 01:00:00,NaN\n".encode())
    df = files.read_csv(spark, str(good), "datetime timestamp_ntz, load_kwh double")
    assert [tuple(r) for r in df.orderBy("datetime").collect()] == [(datetime(2024, 1, 1), 1.5), (datetime(2024, 1, 1, 1), None)]


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(1 / 3, 2)], "a double, b int")
    assert tuple(files.fixed_decimals(df).first()) == ("0.3333333333", 2)


def test_summary_and_files_of_a_horizon(spark, processed, table, tmp_path):
    """Eight split folders, both statistics and the summary, and reading them back."""
    _, scaled_rows, _ = processed
    wide = add(
        scaled_rows.drop("load_kwh_scaled"),
        {
            **{c: "1.0D" for c in preprocess.ALL_FEATURES if c not in CORE},
            **{c: "0" for c in preprocess.DIAGNOSTIC_COLUMNS},
            "target_1h": "CASE WHEN hour(datetime) = 0 THEN NULL ELSE load_kwh END",
            "target_24h": "load_kwh - 130",  # below zero for some rows
        },
    )
    wide.write.parquet(str(tmp_path / "wide"))
    preprocess.run(spark, str(tmp_path / "wide"), str(tmp_path / "out"))
    one = spark.read.parquet(str(tmp_path / "out/summary/horizon=1h")).toPandas().set_index("split")
    usable = table[table["datetime"].dt.hour != 0]
    in_test = int((usable["datetime"] >= "2025-01-01").sum())
    assert (one.loc["all", "rows"], one.loc["test", "rows"]) == (len(usable), in_test)
    assert one.loc["train", "rows"] == len(usable) - in_test
    day = spark.read.parquet(str(tmp_path / "out/summary/horizon=24h")).toPandas().set_index("split")
    assert day.loc["all", "rows"] == wide.filter("target_24h >= 0").count()
    for horizon in ("1h", "24h"):
        rows, raw, stats = preprocess.load(spark, str(tmp_path / "out"), horizon, "extended")
        assert rows.count() == raw.count() > 0 and len(stats) == len(preprocess.ALL_FEATURES) + 1
        assert rows.agg({f"target_{horizon}_scaled": "max"}).first()[0] <= 1.25
    assert files.read_split_dataset(spark, str(tmp_path / "out"), "scaled", "core", "1h", "test").count() == in_test


def test_nan_rows_are_removed_and_ignored(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (nan, 2.0), (3.0, nan), (None, 1.0), (5.0, 9.0)], "f double, t double")
    assert [tuple(r) for r in remove_invalid_rows(df, ["f"], "t").collect()] == [(1.0, 2.0), (5.0, 9.0)]
    assert removed_row_count(df, ["f"], "t").first()["removed_rows"] == 3
    assert collect_stats(minmax_stats(df, ["f", "t"])) == {"f": ColumnStats(1.0, 5.0, 4.0), "t": ColumnStats(1.0, 9.0, 8.0)}
    with pytest.raises(DataQualityError, match=r"not finite: \['f'\]"):
        collect_stats(minmax_stats(df.unionByName(df.selectExpr("double('inf') AS f", "t")), ["f"]))


def test_two_writes_keep_each_others_folders(spark, tmp_path):
    for horizon, value in (("1h", 1.0), ("24h", 2.0), ("1h", 3.0)):
        rows = spark.createDataFrame([("core", horizon, value)], "dataset string, horizon string, mae double")
        files.write_model_metrics(rows, str(tmp_path / "m"))
        files.write_model_predictions(rows, str(tmp_path / "p"))
    for part in ("m", "p"):
        back = spark.read.parquet(str(tmp_path / part))
        assert {(r["horizon"], r["mae"]) for r in back.collect()} == {("1h", 3.0), ("24h", 2.0)}


def test_only_nameless_empty_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, None, None, None, "x")], "a int, _comment string, _c7 string, `Unnamed: 0` string, _c8 string")
    assert files.drop_empty_unnamed(df).columns == ["a", "_comment", "_c8"]


def test_sums_keep_small_values_and_survive_nan_and_large_ones(spark):
    rows = [(datetime(2024, 1, 1, h), 1, "view", v, None) for h, v in [(0, 0.00004)] * 100 + [(1, 1e15), (1, float("nan")), (2, float("nan"))]]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    got = {r["datetime"].hour: r["load_kwh"] for r in panel.hourly_panel(events).collect()}
    assert got == {0: 0.004, 1: 1e15, 2: None}
