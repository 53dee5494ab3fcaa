"""Expressions: null rules, rounding, calendar edges, presence rules."""

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.fixed_values import EXTENDED_FEATURES, PROFILES, WIDE_COLUMNS
from gridweave.functions.calendar import add_calendar
from gridweave.functions.guards import clip, flag, half_even, not_finite, number
from gridweave.functions.nested import flatten
from gridweave.functions.text import constant_rows, num
from gridweave.functions.weather import add_weather_features, clamp_physical
from gridweave.operators.holidays import holiday_intervals, mark_holidays
from gridweave.plans.wide import household_rows

WEATHER = "datetime timestamp_ntz, temperature double, humidity double, apparent_temperature double, rain double, wind_speed double, cloud_cover double"


def one(spark, expr):
    return spark.sql(f"SELECT {expr} AS v").first()["v"]


def test_column_lists():
    assert len(WIDE_COLUMNS) == 55 and len(EXTENDED_FEATURES) == 34 and len(PROFILES) == 4


def test_clip_keeps_null(spark):
    assert one(spark, clip("CAST(NULL AS DOUBLE)", 0, 1)) is None
    assert one(spark, clip("double(5)", 0, 1)) == 1.0
    assert one(spark, clip("double(-5)", lo=0)) == 0.0


def test_unknown_condition_is_zero(spark):
    assert one(spark, flag("CAST(NULL AS DOUBLE) > 1")) == 0


def test_numbers_from_text(spark):
    assert one(spark, number("'1.5'")) == 1.5
    assert one(spark, number("'n/a'")) is None
    assert one(spark, number("'NaN'")) is None
    assert one(spark, not_finite("double('Infinity')")) is True
    assert one(spark, not_finite("CAST(NULL AS DOUBLE)")) is False


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=50, max_size=50), st.integers(0, 6))
def test_half_even_equals_numpy(spark, values, decimals):
    exprs = ", ".join(half_even(num(v), decimals) for v in values)
    got = spark.sql(f"SELECT array({exprs}) AS v").first()["v"]
    np.testing.assert_array_equal(got, np.round(np.array(values), decimals))


@pytest.mark.parametrize("as_table", [False, True])
def test_holiday_interval_edges(spark, as_table):
    stamps = ["2024-02-07 23:00:00", "2024-02-08 00:00:00", "2024-02-14 23:00:00", "2024-02-15 00:00:00"]
    df = spark.createDataFrame([(datetime.fromisoformat(s),) for s in stamps], "datetime timestamp_ntz")
    got = mark_holidays(df, holiday_intervals(spark) if as_table else None).orderBy("datetime").collect()
    assert [r["holiday_effect"] for r in got] == [0, 1, 1, 0]


def test_overlapping_intervals_keep_rows(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2),)], "datetime timestamp_ntz")
    spans = constant_rows(
        spark,
        [
            {"start_date": "DATE'2024-01-01'", "end_date": "DATE'2024-01-03'"},
            {"start_date": "DATE'2024-01-02'", "end_date": "DATE'2024-01-05'"},
        ],
    )
    assert [r["holiday_effect"] for r in mark_holidays(df, spans).collect()] == [1]


def test_monday_is_zero_and_hours_do_not_shift(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 31, 2),), (datetime(2024, 4, 1, 23),)], "datetime timestamp_ntz")
    rows = add_calendar(mark_holidays(df)).orderBy("datetime").collect()
    assert [(r["hour"], r["day_of_week"], r["is_weekend"], r["is_workday"]) for r in rows] == [(2, 6, 1, 0), (23, 0, 0, 1)]


def test_null_weather_gives_zero_flags_and_null_degrees(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 10, 12), None, None, None, None, None, None)], WEATHER)
    row = add_weather_features(add_calendar(mark_holidays(clamp_physical(df)))).first()
    assert (row["humid_hot"], row["rainy_hour"], row["heavy_rain"], row["dark_or_cloudy"]) == (0, 0, 0, 0)
    assert row["cooling_degree"] is None and row["rain"] is None


def reference_share(hour, weekend, holiday, rainy, cooling, workday_share, weekend_share):
    working = 8 <= hour <= 17 and not weekend and not holiday
    share = workday_share if working else 0.34
    if (weekend or holiday) and 8 <= hour <= 17:
        share = weekend_share
    if 11 <= hour <= 12 and not weekend and not holiday:
        share = max(share, 0.26)
    if 6 <= hour <= 8:
        share = max(share, 0.72)
    if 18 <= hour <= 22:
        share = max(share, 0.90)
    if hour <= 5 or hour >= 23:
        share = max(share, 0.95)
    if holiday:
        share = min(1.0, share + 0.10)
    if rainy or cooling >= 6:
        share = min(1.0, share + 0.05)
    return share


def test_presence_rules_with_overlaps(spark):
    days = {"2024-02-09": (False, True), "2024-02-10": (True, True), "2024-03-02": (True, False), "2024-03-05": (False, False)}
    rows = [
        (datetime.fromisoformat(f"{d} {h:02d}:00:00"), 31.0, 80.0, felt, rain, 1.0, 50.0)
        for d in days
        for h in range(24)
        for felt, rain in ((20.0, 0.0), (33.0, 0.0), (20.0, 2.0))
    ]
    got = household_rows(spark.createDataFrame(rows, WEATHER)).collect()
    assert len(got) == len(rows) * 4
    for r in got:
        weekend, holiday = days[r["datetime"].strftime("%Y-%m-%d")]
        want = reference_share(
            r["datetime"].hour, weekend, holiday, r["rain"] > 0, r["apparent_temperature"] - 27, r["home_workday"], r["home_weekend"]
        )
        assert r["occupancy_share_exact"] == want
        assert r["occupancy_level"] == np.round(want * r["household_size"], 3)


def test_flatten(spark):
    df = spark.sql("SELECT named_struct('b', named_struct('c', 1, 'd', array(1, 2)), 'e', 'x') AS a, 5 AS f")
    assert flatten(df).first().asDict() == {"a.b.c": 1, "a.b.d": "[1,2]", "a.e": "x", "f": 5}
