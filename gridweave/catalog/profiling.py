"""Profiling tables and figure data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.catalog.sql import r
from gridweave.fixed_values import CORRELATION_COLUMNS, DIAGNOSTIC_COLUMNS, WIDE_COLUMNS
from gridweave.functions.text import add, put
from gridweave.operators import summary

KEY = ["series_id", "datetime"]
DESCRIBED = ["mean", "std", "min", "p25", "p50", "p75", "max"]
NUMERIC = [
    "load_kwh", "temperature", "humidity", "apparent_temperature", "rain", "wind_speed", "cloud_cover", "occupancy_level",
]
FIGURE_HOURS = 24 * 14


def describe_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(summary.describe(i.hourly(spark, sf), ["load_kwh"], ["series_id"]), DESCRIBED)


def describe_columns(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(summary.describe(i.hourly(spark, sf), NUMERIC), DESCRIBED)


def describe_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles by narrowing instead of buffering, as used beyond a million values per group."""
    narrowed = summary.describe(i.hourly(spark, sf), ["load_kwh"], ["series_id"], buffer_rows=100)
    return i.rounded(narrowed, DESCRIBED)


def shape_columns(spark: SparkSession, sf: str) -> DataFrame:
    return summary.shape_report(i.wide_table(spark, sf))


def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the panel with its lags; every seventh load is NaN, which is missing."""
    lags = i.panel_lags(spark, sf, drop_incomplete=False)
    return summary.missing_report(put(lags, {"load_kwh": "CASE WHEN wind_speed % 7 = 0 THEN double('NaN') ELSE load_kwh END"}))


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return i.wide_table(spark, sf)


def low_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return summary.low_cardinality(_flags(spark, sf))


def top_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(summary.top_correlations(i.wide_table(spark, sf), "load_kwh"), ["r"])


def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return summary.top_rows(i.hourly(spark, sf).select(*KEY, "load_kwh"), "load_kwh", KEY)


def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    return summary.head(i.hourly(spark, sf).select(*KEY, "load_kwh"), KEY)


def tail_rows(spark: SparkSession, sf: str) -> DataFrame:
    return summary.tail(i.hourly(spark, sf).select(*KEY, "load_kwh"), KEY)


def load_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(summary.histogram(i.hourly(spark, sf), "load_kwh"), ["bin_start", "bin_end"])


def mean_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    hours = add(i.hourly(spark, sf).select("datetime", "load_kwh"), {"hour": "hour(datetime)"})
    return i.rounded(summary.group_mean(hours, "hour", "load_kwh"), ["mean_load_kwh"])


def mean_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(summary.group_mean(i.hourly(spark, sf), "series_id", "load_kwh"), ["mean_load_kwh"])


def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(summary.correlation_matrix(i.wide_table(spark, sf), list(CORRELATION_COLUMNS)), ["r"])


def correlation_all(spark: SparkSession, sf: str) -> DataFrame:
    """All numeric columns of the wide table against each other; two of them with missing values."""
    holes = {"humidity": "CASE WHEN hour % 5 = 0 THEN NULL ELSE humidity END", "load_lag_24": "CASE WHEN hour % 7 = 0 THEN double('NaN') ELSE load_lag_24 END"}
    wide = put(i.wide_table(spark, sf), holes)
    return i.rounded(summary.correlation_matrix(wide, summary.numeric_columns(wide)), ["r"])


def indicator_rates(spark: SparkSession, sf: str) -> DataFrame:
    names = [*DIAGNOSTIC_COLUMNS[1:], "holiday_effect"]
    return i.rounded(summary.indicator_rates(i.wide_table(spark, sf), names), names)


def series_count(spark: SparkSession, sf: str) -> DataFrame:
    return summary.series_count(i.events(spark, sf), "user_id")


SPANS = {"day": "string(day)", "week": "string(to_date(date_trunc('week', day)))", "all": "'all'"}


def series_count_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users of every day, week and the whole time: exact, and whether the counts merged from the
    stored sketches of the days come within five standard errors."""
    events = i.events(spark, sf)
    sketches = summary.daily_sketches(events, "user_id", "ts")
    frames = []
    for kind, span in SPANS.items():
        users = events.selectExpr("to_date(ts) AS day", "user_id").selectExpr(f"{span} AS span", "user_id")
        exact = users.groupBy("span").agg(F.countDistinct("user_id").alias("users"))
        both = exact.join(summary.merged_count(sketches, span, "span"), "span")
        frames.append(both.selectExpr(f"'{kind}' AS kind", "span", "users", "abs(series - users) <= 0.08D * users + 1D AS close"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def figure_data(spark: SparkSession, sf: str) -> DataFrame:
    """First two weeks of readings in time order, as drawn."""
    rows = i.hourly(spark, sf).select("datetime", "series_id", "load_kwh")
    return rows.orderBy("datetime", "series_id").limit(FIGURE_HOURS)


QUERIES = {
    f.__name__: f
    for f in (
        describe_by_series, describe_columns, describe_narrowed, shape_columns, missing_report, low_cardinality,
        top_correlations, top_values, head_rows, tail_rows, load_histogram, mean_by_hour, mean_by_series,
        correlation_matrix, correlation_all, indicator_rates, series_count, series_count_daily, figure_data,
    )
}


def _describe(column: str, name: str) -> str:
    return f"""'{name}' AS "column", count({column}) AS "count", {r(f"avg({column})")} AS "mean", {r(f"stddev_samp({column})")} AS std,
       {r(f"min({column})")} AS "min", {r(f"quantile_cont({column}, 0.25)")} AS p25, {r(f"quantile_cont({column}, 0.5)")} AS p50,
       {r(f"quantile_cont({column}, 0.75)")} AS p75, {r(f"max({column})")} AS "max" """


_BY_SERIES = q.BASE + f"SELECT series_id, {_describe('load_kwh', 'load_kwh')} FROM panel GROUP BY series_id"
_KINDS = {"datetime": "timestamp_ntz", "profile_code": "int", "profile_name": "string", "household_size": "int"}
# integer columns of the wide table; the others are doubles
_WHOLE = {
    *DIAGNOSTIC_COLUMNS, "hour", "day_of_week", "day_of_year", "month", "is_weekend", "is_workday", "holiday_effect",
    "season_code", "sleep_hour", "morning_peak", "evening_peak", "breakfast_hour", "lunch_hour", "dinner_hour",
    "working_hour", "school_vacation", "usage_period", "humid_hot", "rainy_hour", "heavy_rain", "dark_or_cloudy",
}
_NUMBERS = [c for c in WIDE_COLUMNS if c not in ("datetime", "profile_name")]
_LIMITS = "lim AS (SELECT min(load_kwh) AS lo, max(load_kwh) AS hi FROM panel)"

ORACLE = {
    "describe_by_series": _BY_SERIES,
    "describe_narrowed": _BY_SERIES,
    "describe_columns": q.BASE
    + " UNION ALL ".join(f"SELECT {_describe(f'CAST({c} AS DOUBLE)', c)} FROM panel" for c in NUMERIC),
    "shape_columns": q.WIDE
    + " UNION ALL ".join(
        f"""SELECT count(*) AS rows, {n} AS position, '{c}' AS "column", '{_KINDS.get(c, "int" if c in _WHOLE else "double")}' AS type FROM wide"""
        for n, c in enumerate(WIDE_COLUMNS)
    ),
    "missing_report": q.LAGS
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({f"CASE WHEN wind_speed % 7 <> 0 THEN {c} END" if c == "load_kwh" else c}) AS missing FROM lags_all"""
        for c in (*KEY, *NUMERIC, "load_lag_1", "load_lag_24", "load_rolling_3", "load_rolling_24", "target_1h", "target_24h")
    ),
    "low_cardinality": q.WIDE
    + ", seen AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", CAST({c} AS DOUBLE) AS n FROM wide""" for c in _NUMBERS
    )
    + """ UNION ALL SELECT 'profile_name', profile_name, NULL FROM wide),
few AS (SELECT "column" FROM seen GROUP BY 1 HAVING count(DISTINCT "value") <= 5 OR "column" = 'profile_name' ORDER BY 1 LIMIT 15)
SELECT "column", "value", count(*) AS rows FROM seen JOIN few USING ("column") GROUP BY 1, 2""",
    "top_correlations": q.WIDE
    + """SELECT * FROM (SELECT "column", CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM ("""
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {r(f"corr({c}, load_kwh)")} AS r FROM wide""" for c in _NUMBERS)
    + """)) ORDER BY r DESC NULLS LAST, "column" LIMIT 15""",
    "top_values": q.BASE + "SELECT series_id, datetime, load_kwh FROM panel ORDER BY load_kwh DESC, series_id, datetime LIMIT 10",
    "head_rows": q.BASE + "SELECT series_id, datetime, load_kwh FROM panel ORDER BY series_id, datetime LIMIT 5",
    "tail_rows": q.BASE + "SELECT series_id, datetime, load_kwh FROM panel ORDER BY series_id DESC, datetime DESC LIMIT 5",
    "load_histogram": q.with_(q.EV, q.PANEL, _LIMITS)
    + f""", binned AS (SELECT CAST(least(floor(50 * (load_kwh - lo) / (hi - lo)), 49) AS INTEGER) AS bin, lo, hi FROM panel, lim)
SELECT bin, {r("lo + bin * ((hi - lo) / 5e1)")} AS bin_start, {r("lo + (bin + 1) * ((hi - lo) / 5e1)")} AS bin_end, count(*) AS rows
FROM binned GROUP BY bin, lo, hi""",
    "mean_by_hour": q.BASE
    + f"SELECT CAST(hour(datetime) AS INTEGER) AS hour, {r('avg(load_kwh)')} AS mean_load_kwh FROM panel GROUP BY 1",
    "mean_by_series": q.BASE + f"SELECT series_id, {r('avg(load_kwh)')} AS mean_load_kwh FROM panel GROUP BY 1",
    "correlation_matrix": q.WIDE
    + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {r(f'corr({x}, {y})')} AS r FROM wide" for x in CORRELATION_COLUMNS for y in CORRELATION_COLUMNS
    ),
    "correlation_all": q.WIDE
    + ", held AS (SELECT * REPLACE (CASE WHEN hour % 5 = 0 THEN NULL ELSE humidity END AS humidity, CASE WHEN hour % 7 = 0 THEN NULL ELSE load_lag_24 END AS load_lag_24) FROM wide), rs AS ("
    + " UNION ALL ".join("SELECT '" + x + "' AS x, " + ", ".join(f"corr({x}, {y}) AS {y}" for y in _NUMBERS) + " FROM held" for x in _NUMBERS)
    + f""") SELECT x, y, {r("CASE WHEN isnan(v) THEN NULL ELSE v END")} AS r FROM rs UNPIVOT INCLUDE NULLS (v FOR y IN ({", ".join(_NUMBERS)}))""",
    "indicator_rates": q.WIDE
    + "SELECT "
    + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in [*DIAGNOSTIC_COLUMNS[1:], "holiday_effect"])
    + " FROM wide",
    "series_count": "SELECT count(DISTINCT user_id) AS series FROM events",
    "series_count_daily": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {span} AS span, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 2"
        for kind, span in (("day", "CAST(CAST(ts AS DATE) AS VARCHAR)"), ("week", "CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR)"), ("all", "'all'"))
    ),
    "figure_data": q.BASE + f"SELECT datetime, series_id, load_kwh FROM panel ORDER BY datetime, series_id LIMIT {FIGURE_HOURS}",
}
