"""Shared parts of the checking SQL, written for DuckDB and independent of the Spark code."""

from __future__ import annotations

from gridweave.fixed_values import (
    CORE_FEATURES,
    EXTENDED_FEATURES,
    HOLIDAYS,
    PROFILE_COLUMNS,
    PROFILES,
    WIDE_COLUMNS,
)

# added before rounding, so that exact ties do not depend on the last bit of a sum
PRINT_MARGIN = 0.0312345
TRAIN_END = "TIMESTAMP '2024-01-23 00:00:00'"
VALIDATION_START = "TIMESTAMP '2024-01-16 00:00:00'"
ALL_FEATURES = sorted({*CORE_FEATURES, *EXTENDED_FEATURES})


def half_even(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def r(expr: str, digits: int = 6) -> str:
    """Printed digits; see ``inputs.printed`` for the margin."""
    return f"(round_even(({expr}) * 1e{digits} + CAST('{PRINT_MARGIN!r}' AS DOUBLE), 0) / 1e{digits} + 0e0)"


def d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

SUM_VALUE = "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE)"
WEATHER_AGG = f"""
    (min(value) + max(value)) / 2e0 AS temperature,
    CAST(sum(k) AS DOUBLE) / count(k) AS humidity,
    {SUM_VALUE} / count(value) AS apparent_temperature,
    CAST(min(k) AS DOUBLE) AS rain,
    CAST(count(*) AS DOUBLE) AS wind_speed,
    CAST(max(k) AS DOUBLE) AS cloud_cover"""

PANEL = f"""
panel AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS datetime, {SUM_VALUE} AS load_kwh, {WEATHER_AGG},
         count(DISTINCT user_id) AS occupancy_level
  FROM ev GROUP BY 1, 2)"""
WEATHER = f"weather AS (SELECT date_trunc('hour', ts) AS datetime, {WEATHER_AGG} FROM ev GROUP BY 1)"
LOADS = f"""
loads AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS profile_code, date_trunc('hour', ts) AS datetime, {SUM_VALUE} AS load_kwh,
         CAST(max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS INTEGER) AS laundry_activity,
         CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS INTEGER) AS cooking_spike,
         CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS appliance_spike,
         CAST(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS INTEGER) AS ac_startup_spike,
         CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS outage_anomaly
  FROM ev GROUP BY 1, 2)"""
HOLIDAY_ROWS = "holidays(a, b) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in HOLIDAYS) + ")"


def calendar(source: str, name: str = "cal") -> str:
    """Three CTEs that add the calendar columns to ``source``."""
    return f"""
{name}_1 AS (
  SELECT *, CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
         CAST(dayofyear(datetime) AS INTEGER) AS day_of_year, CAST(month(datetime) AS INTEGER) AS month,
         CASE WHEN isodow(datetime) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN EXISTS (SELECT 1 FROM holidays WHERE CAST(datetime AS DATE) BETWEEN a AND b) THEN 1 ELSE 0 END
           AS holiday_effect
  FROM {source}),
{name}_2 AS (
  SELECT *, CASE WHEN is_weekend = 0 AND holiday_effect = 0 THEN 1 ELSE 0 END AS is_workday,
         sin(2e0 * pi() * hour / 24e0) AS hour_sin, cos(2e0 * pi() * hour / 24e0) AS hour_cos,
         sin(2e0 * pi() * day_of_week / 7e0) AS day_sin, cos(2e0 * pi() * day_of_week / 7e0) AS day_cos,
         sin(2e0 * pi() * month / 12e0) AS month_sin, cos(2e0 * pi() * month / 12e0) AS month_cos,
         CASE WHEN month IN (12, 1, 2) THEN 0 WHEN month IN (3, 4) THEN 1
              WHEN month BETWEEN 5 AND 9 THEN 2 ELSE 3 END AS season_code,
         CASE WHEN hour <= 5 OR hour >= 23 THEN 1 ELSE 0 END AS sleep_hour,
         CASE WHEN hour BETWEEN 6 AND 8 THEN 1 ELSE 0 END AS morning_peak,
         CASE WHEN hour BETWEEN 18 AND 22 THEN 1 ELSE 0 END AS evening_peak,
         CASE WHEN hour BETWEEN 6 AND 7 THEN 1 ELSE 0 END AS breakfast_hour,
         CASE WHEN hour BETWEEN 11 AND 12 THEN 1 ELSE 0 END AS lunch_hour,
         CASE WHEN hour BETWEEN 18 AND 20 THEN 1 ELSE 0 END AS dinner_hour,
         CASE WHEN month IN (6, 7) THEN 1 ELSE 0 END AS school_vacation,
         CASE WHEN hour <= 5 THEN 0 WHEN hour <= 8 AND hour >= 6 OR hour BETWEEN 18 AND 22 THEN 2 ELSE 1 END
           AS usage_period
  FROM {name}_1),
{name} AS (
  SELECT *, CASE WHEN hour BETWEEN 8 AND 17 AND is_workday = 1 THEN 1 ELSE 0 END AS working_hour,
         8e-1 * breakfast_hour + 5e-1 * lunch_hour + 12e-1 * dinner_hour + 25e-2 * holiday_effect AS meal_activity
  FROM {name}_2)"""


def clamped(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT * REPLACE (greatest(rain, 0e0) AS rain, least(greatest(humidity, 0e0), 1e2) AS humidity,
                    least(greatest(cloud_cover, 0e0), 1e2) AS cloud_cover)
  FROM {source})"""


def weather_features(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, greatest(apparent_temperature - 27e0, 0e0) AS cooling_degree,
         greatest(18e0 - apparent_temperature, 0e0) AS heating_degree,
         CASE WHEN temperature >= 30 AND humidity >= 75 THEN 1 ELSE 0 END AS humid_hot,
         CASE WHEN rain > 0 THEN 1 ELSE 0 END AS rainy_hour,
         CASE WHEN rain >= 10 THEN 1 ELSE 0 END AS heavy_rain,
         CASE WHEN hour >= 18 OR hour <= 5 OR cloud_cover >= 85 THEN 1 ELSE 0 END AS dark_or_cloudy,
         temperature * humidity AS temp_humidity_interaction
  FROM {source})"""


def _profile_value(v: object) -> str:
    return f"'{v}'" if isinstance(v, str) else d(v) if isinstance(v, float) else str(v)


PROFILE_ROWS = (
    f"profiles({', '.join(PROFILE_COLUMNS)}) AS (VALUES "
    + ", ".join("(" + ", ".join(_profile_value(v) for v in p) + ")" for p in PROFILES)
    + ")"
)
# the presence rules one after the other, each as its own step
OCCUPANCY = """
occ_1 AS (
  SELECT *, CASE WHEN (is_weekend = 1 OR holiday_effect = 1) AND hour BETWEEN 8 AND 17 THEN home_weekend
                 WHEN working_hour = 1 THEN home_workday ELSE 34e-2 END AS s1
  FROM feat, profiles),
occ_2 AS (SELECT *, CASE WHEN lunch_hour = 1 AND is_weekend = 0 AND holiday_effect = 0 THEN greatest(s1, 26e-2) ELSE s1 END AS s2 FROM occ_1),
occ_3 AS (SELECT *, CASE WHEN morning_peak = 1 THEN greatest(s2, 72e-2) ELSE s2 END AS s3 FROM occ_2),
occ_4 AS (SELECT *, CASE WHEN evening_peak = 1 THEN greatest(s3, 90e-2) ELSE s3 END AS s4 FROM occ_3),
occ_5 AS (SELECT *, CASE WHEN sleep_hour = 1 THEN greatest(s4, 95e-2) ELSE s4 END AS s5 FROM occ_4),
occ_6 AS (SELECT *, CASE WHEN holiday_effect = 1 THEN least(1e0, s5 + 10e-2) ELSE s5 END AS s6 FROM occ_5),
occ AS (
  SELECT *, CASE WHEN rainy_hour = 1 OR cooling_degree >= 6 THEN least(1e0, s6 + 5e-2) ELSE s6 END AS share
  FROM occ_6)"""
HOUSEHOLDS = f"""
households AS (
  SELECT *, {half_even('share * household_size', 3)} AS occupancy_level, {half_even('share', 3)} AS occupancy_share FROM occ)"""


def lag_block(source: str, name: str, key: str) -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY datetime"
    units = "CAST(round_even(load_kwh * 1e4, 0) AS BIGINT)"

    def rolling(n: int) -> str:
        frame = f"{over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return f"CASE WHEN count(load_kwh) {frame} = {n} THEN round_even(CAST(sum({units}) {frame} AS DOUBLE) / {n}e0, 0) / 1e4 END"

    return f"""
{name}_all AS (
  SELECT *, {half_even(f'lag(load_kwh, 1) {over})', 4)} AS load_lag_1, {half_even(f'lag(load_kwh, 24) {over})', 4)} AS load_lag_24,
         {rolling(3)} AS load_rolling_3, {rolling(24)} AS load_rolling_24,
         {half_even(f'lead(load_kwh, 1) {over})', 4)} AS target_1h, {half_even(f'lead(load_kwh, 24) {over})', 4)} AS target_24h
  FROM {source}),
{name} AS (
  SELECT * FROM {name}_all WHERE load_lag_1 IS NOT NULL AND load_lag_24 IS NOT NULL AND load_rolling_3 IS NOT NULL
    AND load_rolling_24 IS NOT NULL AND target_1h IS NOT NULL AND target_24h IS NOT NULL)"""


BASE = with_(EV, PANEL)
CALENDAR = with_(EV, PANEL, HOLIDAY_ROWS, clamped("panel", "pc"), calendar("pc"), weather_features("cal", "feat"))
LAGS = with_(EV, PANEL, lag_block("panel", "lags", "series_id"))
_HOUSE = (EV, WEATHER, LOADS, HOLIDAY_ROWS, PROFILE_ROWS, clamped("weather", "wc"), calendar("wc"), weather_features("cal", "feat"), OCCUPANCY, HOUSEHOLDS)
HOUSE = with_(*_HOUSE)
JOINED = "joined AS (SELECT * FROM households JOIN loads USING (profile_code, datetime))"
_WIDE = (*_HOUSE, JOINED, lag_block("joined", "wide", "profile_code"))
WIDE = with_(*_WIDE)


def wide_plus(*ctes: str) -> str:
    return with_(*_WIDE, *ctes)


def splits(source: str = "wide", name: str = "rows1") -> str:
    return f"""
{name} AS (SELECT *, CASE WHEN datetime < {TRAIN_END} THEN 'train' ELSE 'test' END AS split,
                  CASE WHEN datetime < {VALIDATION_START} THEN 'train_fit' WHEN datetime < {TRAIN_END} THEN 'validation' ELSE 'test' END AS fit_split
           FROM {source})"""


def stats(columns: list[str], name: str = "st") -> str:
    parts = ", ".join(
        f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CASE WHEN max({c}) = min({c}) THEN 1e0 ELSE CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE) END AS span_{c}"
        for c in columns
    )
    return f"{name} AS (SELECT {parts} FROM rows1 WHERE split = 'train')"


def scaled(c: str, lo: float = -0.25, hi: float = 1.25) -> str:
    return f"least(greatest((CAST({c} AS DOUBLE) - lo_{c}) / span_{c}, {d(lo)}), {d(hi)})"


WIDE_LIST = ", ".join(
    r(c) + f" AS {c}" if c.endswith(("_sin", "_cos")) or c == "meal_activity" else c for c in WIDE_COLUMNS
)
