"""Panels, calendar, weather, household, window and gap-fill queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.catalog.sql import r
from gridweave.functions.calendar import hour_start
from gridweave.functions.text import add
from gridweave.operators.dedup import duplicate_count, keep_first, repeated_rows
from gridweave.operators.evaluate import plot_window, plot_windows
from gridweave.operators.gapfill import dense_grid, interpolate
from gridweave.operators.holidays import holiday_intervals, mark_holidays
from gridweave.operators.profiles import attach, profile_table
from gridweave.operators.series import Series, add_lag_block, first_series, rows_bound
from gridweave.plans import panel
from gridweave.sources.payload import build_payload, explode_payload
from gridweave.sources.tables import read_table

WEATHER = ["temperature", "humidity", "apparent_temperature", "rain", "wind_speed", "cloud_cover"]
WAVES = ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]
CALENDAR = [
    "hour", "day_of_week", "day_of_year", "month", "is_weekend", "is_workday", "holiday_effect", "season_code",
    "sleep_hour", "morning_peak", "evening_peak", "working_hour", "school_vacation", "usage_period",
]
FLAGS = ["cooling_degree", "heating_degree", "humid_hot", "rainy_hour", "heavy_rain", "dark_or_cloudy"]
LAGS = ["load_lag_1", "load_lag_24", "load_rolling_3", "load_rolling_24", "target_1h", "target_24h"]
KEY = ["series_id", "datetime"]


def panel_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(i.hourly(spark, sf), ["humidity", "apparent_temperature"])


def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(i.panel_features(spark, sf).select(*KEY, *CALENDAR, *WAVES), WAVES)


def weather_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = i.panel_features(spark, sf).select(*KEY, "rain", "humidity", "cloud_cover", *FLAGS, "temp_humidity_interaction")
    return i.rounded(out, ["humidity", "cooling_degree", "heating_degree", "temp_humidity_interaction"])


def meal_hours(spark: SparkSession, sf: str) -> DataFrame:
    out = i.panel_features(spark, sf).select(*KEY, "breakfast_hour", "lunch_hour", "dinner_hour", "meal_activity")
    return i.rounded(out, ["meal_activity"])


def holiday_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events on holidays and other days, against an interval table."""
    marked = mark_holidays(i.events(spark, sf), holiday_intervals(spark), ts="ts")
    daily = add(marked, {"day": "date_format(ts, 'yyyy-MM-dd')"})
    return daily.groupBy("day", "holiday_effect").count().withColumnRenamed("count", "events")


def profile_cross_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return i.households(spark, sf).select(
        "datetime", "profile_code", "profile_name", "household_size", "occupancy_share", "occupancy_level"
    )


def profile_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Load per profile beside its attributes, by key."""
    loads = panel.hourly_load(i.events(spark, sf))
    profiles = profile_table(spark).select("profile_code", "profile_name", "household_size", "base_load_kw")
    return attach(loads.select("profile_code", "datetime", "load_kwh"), profiles)


def array_json_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Panel to one payload per series and day, and back to rows."""
    payloads = build_payload(i.hourly(spark, sf), ["series_id"])
    return i.rounded(explode_payload(payloads), ["humidity", "apparent_temperature"])


def lag_target_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return i.panel_lags(spark, sf).select(*KEY, "load_kwh", *LAGS)


def lag_target_rolling_split_series(spark: SparkSession, sf: str) -> DataFrame:
    """The same without a row bound: series are cut into chunks of row positions."""
    lagged = add_lag_block(i.hourly(spark, sf), i.PANEL_SERIES, bound=None, chunk_rows=64)
    return lagged.select(*KEY, "load_kwh", *LAGS)


def lag_target_user_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Many sparse series: one per user."""
    users = panel.user_hour_panel(i.events(spark, sf))
    return add_lag_block(users, i.PANEL_SERIES, bound=i.hourly_bound(spark, sf)).select(*KEY, "load_kwh", *LAGS)


def lag_supplier_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily grid: lag 1 and 7, next day, mean of the last seven rows, per supplier."""
    items = read_table(spark, sf, "lineitem")
    return add_lag_block(
        panel.supplier_daily_panel(items),
        Series(step="day"),
        lags={"lag_1": 1, "lag_7": 7},
        leads={"next_1": 1},
        rolling={"rolling_7": 7},
        bound=rows_bound(items, "l_shipdate", "day"),
    ).select(*KEY, "load_kwh", "lag_1", "lag_7", "next_1", "rolling_7")


def _gap_fill(spark: SparkSession, sf: str, bound: int | None, **sizes: int) -> DataFrame:
    columns = ["load_kwh", "apparent_temperature"]
    grid = dense_grid(i.hourly(spark, sf).select(*KEY, *columns), i.PANEL_SERIES)
    return i.rounded(interpolate(grid, i.PANEL_SERIES, columns, bound=bound, **sizes), columns)


def gap_fill_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _gap_fill(spark, sf, i.hourly_bound(spark, sf))


def gap_fill_linear_split_series(spark: SparkSession, sf: str) -> DataFrame:
    """The same without a row bound: buckets of 64 hours carry their edges to the neighbours."""
    return _gap_fill(spark, sf, None, bucket_steps=64)


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """First event of every type and hour."""
    rows = i.events(spark, sf).selectExpr(
        "event_type", f"{hour_start('ts')} AS datetime", "ts", "event_id", "user_id", "value"
    )
    return keep_first(rows, ["event_type", "datetime"], ["ts", "event_id"])


def _repeatable(spark: SparkSession, sf: str) -> DataFrame:
    return i.events(spark, sf).selectExpr("event_type", "user_id", "date_format(ts, 'yyyy-MM-dd') AS day")


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_rows(_repeatable(spark, sf))


def duplicate_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_count(_repeatable(spark, sf))


def first_profile(spark: SparkSession, sf: str) -> DataFrame:
    return first_series(i.hourly(spark, sf), i.PANEL_SERIES)


def plot_window_first_series(spark: SparkSession, sf: str) -> DataFrame:
    return plot_window(i.hourly(spark, sf).select(*KEY, "load_kwh"), series=i.PANEL_SERIES)


def plot_window_all_series(spark: SparkSession, sf: str) -> DataFrame:
    return plot_windows(i.hourly(spark, sf).select(*KEY, "load_kwh"), series=i.PANEL_SERIES)


def wide_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(i.wide_table(spark, sf), [*WAVES, "meal_activity"])


QUERIES = {
    f.__name__: f
    for f in (
        panel_hourly, calendar_features, weather_flags, meal_hours, holiday_range_join,
        profile_cross_occupancy, profile_attach, array_json_to_rows, lag_target_rolling,
        lag_target_rolling_split_series, lag_target_user_hours, lag_supplier_daily, gap_fill_linear,
        gap_fill_linear_split_series, dedup_first, duplicate_rows, duplicate_row_count, first_profile,
        plot_window_first_series, plot_window_all_series, wide_dataset,
    )
}


def _cols(names: list[str]) -> str:
    return ", ".join(names)


def _rounded(names: list[str]) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


_LAG_SELECT = f"SELECT series_id, datetime, load_kwh, {_cols(LAGS)} FROM lags"
_GAP = q.BASE + f""",
hours AS (SELECT series_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime
          FROM panel GROUP BY series_id),
grid AS (SELECT hours.series_id, hours.datetime, load_kwh, apparent_temperature,
                row_number() OVER (PARTITION BY hours.series_id ORDER BY hours.datetime) AS pos
         FROM hours LEFT JOIN panel ON panel.series_id = hours.series_id AND panel.datetime = hours.datetime),
near AS (SELECT *,
           max(CASE WHEN load_kwh IS NOT NULL THEN pos END) OVER up AS b, min(CASE WHEN load_kwh IS NOT NULL THEN pos END) OVER down AS a
         FROM grid
         WINDOW up AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                down AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lined AS (SELECT n.series_id, n.datetime, n.pos, n.b, n.a,
                 x.load_kwh AS bl, y.load_kwh AS al, x.apparent_temperature AS bt, y.apparent_temperature AS tt
          FROM near n LEFT JOIN grid x ON x.series_id = n.series_id AND x.pos = n.b
                      LEFT JOIN grid y ON y.series_id = n.series_id AND y.pos = n.a)
SELECT series_id, datetime,
  {r("CASE WHEN a = b THEN bl WHEN b IS NULL THEN al WHEN a IS NULL THEN bl ELSE bl + (pos - b) * (al - bl) / (a - b) END")} AS load_kwh,
  {r("CASE WHEN a = b THEN bt WHEN b IS NULL THEN tt WHEN a IS NULL THEN bt ELSE bt + (pos - b) * (tt - bt) / (a - b) END")} AS apparent_temperature
FROM lined"""


ORACLE = {
    "panel_hourly": q.BASE
    + f"""SELECT series_id, datetime, load_kwh, temperature, {_rounded(["humidity", "apparent_temperature"])}, rain,
       wind_speed, cloud_cover, occupancy_level FROM panel""",
    "calendar_features": q.CALENDAR + f"SELECT series_id, datetime, {_cols(CALENDAR)}, {_rounded(WAVES)} FROM cal",
    "weather_flags": q.CALENDAR
    + f"""SELECT series_id, datetime, rain, cloud_cover, humid_hot, rainy_hour, heavy_rain, dark_or_cloudy,
       {_rounded(["humidity", "cooling_degree", "heating_degree", "temp_humidity_interaction"])} FROM feat""",
    "meal_hours": q.CALENDAR
    + f"""SELECT series_id, datetime, breakfast_hour, lunch_hour, dinner_hour, {r("meal_activity")} AS meal_activity FROM feat""",
    "holiday_range_join": q.with_(q.HOLIDAY_ROWS)
    + """SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN a IS NULL THEN 0 ELSE 1 END AS holiday_effect, count(*) AS events
       FROM events LEFT JOIN holidays ON CAST(ts AS DATE) BETWEEN a AND b GROUP BY 1, 2""",
    "profile_cross_occupancy": q.HOUSE
    + "SELECT datetime, profile_code, profile_name, household_size, occupancy_share, occupancy_level FROM households",
    "profile_attach": q.with_(q.EV, q.LOADS, q.PROFILE_ROWS)
    + """SELECT profile_code, datetime, load_kwh, profile_name, household_size, base_load_kw
       FROM loads LEFT JOIN profiles USING (profile_code)""",
    "array_json_to_rows": q.BASE
    + f"""SELECT series_id, datetime, temperature, {_rounded(["humidity", "apparent_temperature"])}, rain, wind_speed,
       cloud_cover FROM panel""",
    "lag_target_rolling": q.LAGS + _LAG_SELECT,
    "lag_target_rolling_split_series": q.LAGS + _LAG_SELECT,
    "lag_target_user_hours": q.with_(
        f"panel AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS datetime, {q.SUM_VALUE} AS load_kwh FROM events GROUP BY 1, 2)",
        q.lag_block("panel", "lags", "series_id"),
    )
    + _LAG_SELECT,
    "lag_supplier_daily": f"""
WITH panel AS (SELECT l_suppkey AS series_id, date_trunc('day', l_shipdate) AS datetime,
                      CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS load_kwh FROM lineitem GROUP BY 1, 2),
lagged AS (SELECT *, lag(load_kwh, 1) OVER w AS lag_1, lag(load_kwh, 7) OVER w AS lag_7, lead(load_kwh, 1) OVER w AS next_1,
                  sum(CAST(load_kwh AS BIGINT)) OVER (PARTITION BY series_id ORDER BY datetime ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7
           FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY datetime))
SELECT series_id, CAST(datetime AS TIMESTAMP) AS datetime, load_kwh, lag_1, lag_7, next_1, round_even(CAST(s7 * 10000 AS DOUBLE) / 7e0, 0) / 1e4 AS rolling_7
FROM lagged WHERE lag_7 IS NOT NULL AND next_1 IS NOT NULL""",
    "gap_fill_linear": _GAP,
    "gap_fill_linear_split_series": _GAP,
    "dedup_first": """
WITH numbered AS (SELECT event_type, date_trunc('hour', ts) AS datetime, ts, event_id, user_id, value,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events)
SELECT event_type, datetime, ts, event_id, user_id, value FROM numbered WHERE rn = 1""",
    "duplicate_rows": """
SELECT event_type, user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) - 1 AS later_copies FROM events
GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "duplicate_row_count": """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM events GROUP BY event_type, user_id, CAST(ts AS DATE))""",
    "first_profile": q.BASE + "SELECT min(series_id) AS series_id FROM panel",
    "plot_window_first_series": q.BASE
    + """SELECT series_id, datetime, load_kwh FROM panel WHERE series_id = (SELECT min(series_id) FROM panel)
       ORDER BY datetime LIMIT 336""",
    "plot_window_all_series": q.BASE
    + """SELECT series_id, datetime, load_kwh FROM panel
       QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime) <= 336""",
    "wide_dataset": q.WIDE + f"SELECT {q.WIDE_LIST} FROM wide",
}
