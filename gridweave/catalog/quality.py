"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.catalog.sql import r
from gridweave.fixed_values import CORE_FEATURES, META_COLUMNS, WEATHER_COLUMNS
from gridweave.functions.guards import infinite, not_finite, number, parse_time
from gridweave.functions.text import put
from gridweave.operators.quality import (
    finite_report,
    invalid_row,
    quality_checks,
    raw_scaled_parity,
    remove_invalid_rows,
    removed_row_count,
    required_columns_report,
    stats_coverage,
)
from gridweave.operators.scaling import minmax_stats
from gridweave.operators.splits import train_test
from gridweave.operators.summary import low_values
from gridweave.sources.tables import read_table

CORE = list(CORE_FEATURES)
LAGGED = ["load_lag_1", "load_lag_24", "load_rolling_24", "target_24h"]
REQUIRED = ["datetime", *WEATHER_COLUMNS, "pressure"]


def _shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Lag rows with gaps kept and the target moved so that some values fall below zero."""
    return put(i.panel_lags(spark, sf, drop_incomplete=False), {"target_1h": "target_1h - 20"})


def invalid_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return removed_row_count(_shifted(spark, sf), LAGGED, "target_1h")


def invalid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that preprocessing removes."""
    bad = _shifted(spark, sf).filter(invalid_row(LAGGED, "target_1h"))
    return bad.select("series_id", "datetime", *LAGGED, "target_1h")


def valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept = remove_invalid_rows(_shifted(spark, sf), LAGGED, "target_1h")
    return kept.select("series_id", "datetime", "target_1h")


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text, with bad numbers and times where the event id says so."""
    return read_table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 50 = 1 THEN 'n/a' WHEN event_id % 50 = 2 THEN 'Infinity' WHEN event_id % 50 = 3 THEN NULL "
        "WHEN event_id % 50 = 4 THEN 'NaN' ELSE string(value) END AS reading",
        "string(value - 25) AS target",
        "CASE WHEN event_id % 40 = 7 THEN 'yesterday' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS datetime",
    )


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality_checks(_dirty(spark, sf), ["reading"], ["target"], "datetime")


def coerced_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Text to numbers and times; what does not parse becomes null."""
    return _dirty(spark, sf).selectExpr(
        "event_id",
        f"CASE WHEN {infinite(number('reading'))} THEN NULL ELSE {number('reading')} END AS reading",
        f"int({not_finite('try_cast(reading AS DOUBLE)')}) AS not_finite",
        f"{parse_time('datetime')} AS datetime",
    )


def raw_scaled_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and scaled frames of one horizon, with some targets of the scaled side moved."""
    p = i.prepared(spark, sf)
    scaled = put(p.scaled("core"), {"target_1h": "CASE WHEN hour(datetime) = 5 THEN target_1h + 1e-6D ELSE target_1h END"})
    return raw_scaled_parity(p.raw("core"), scaled.filter("hour(datetime) <> 9"), list(META_COLUMNS), "target_1h")


def scaler_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of part of the features against the whole core list, one range set to zero."""
    train, _ = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    stats = put(minmax_stats(train, CORE[:4]), {"range": "CASE `column` WHEN 'humidity' THEN 0.0D ELSE `range` END"})
    return stats_coverage(spark, stats, CORE)


def finite_check(spark: SparkSession, sf: str) -> DataFrame:
    lagged = i.panel_lags(spark, sf, drop_incomplete=False)
    return finite_report(lagged, ["load_kwh", "load_lag_1", "load_lag_24", "target_24h"])


def required_columns(spark: SparkSession, sf: str) -> DataFrame:
    return required_columns_report(i.hourly(spark, sf), REQUIRED)


def low_actuals(spark: SparkSession, sf: str) -> DataFrame:
    _, test = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    return i.rounded(low_values(test, "target_1h", 50.0), ["actual_mean"])


QUERIES = {
    f.__name__: f
    for f in (
        invalid_row_count, invalid_rows, valid_rows, quality_report, coerced_rows, raw_scaled_agreement,
        scaler_coverage, finite_check, required_columns, low_actuals,
    )
}

_SHIFTED = q.LAGS + ", shifted AS (SELECT * REPLACE (target_1h - 20 AS target_1h) FROM lags_all)\n"
_BAD = "(" + " OR ".join(f"{c} IS NULL" for c in [*LAGGED, "target_1h"]) + " OR target_1h < 0)"
_COUNTS = {
    ("missing_or_non_numeric", "reading"): "event_id % 50 IN (1, 3, 4)",
    ("infinite", "reading"): "event_id % 50 = 2",
    ("missing_or_non_numeric", "target"): "false",
    ("infinite", "target"): "false",
    ("negative", "target"): "value - 25 < 0",
    ("invalid_time", "datetime"): "event_id % 40 = 7",
}

ORACLE = {
    "invalid_row_count": _SHIFTED
    + f"""SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_BAD}) AS removed_rows,
       count(*) FILTER (WHERE NOT {_BAD}) AS rows_after FROM shifted""",
    "invalid_rows": _SHIFTED + f"SELECT series_id, datetime, {', '.join(LAGGED)}, target_1h FROM shifted WHERE {_BAD}",
    "valid_rows": _SHIFTED + f"SELECT series_id, datetime, target_1h FROM shifted WHERE NOT {_BAD}",
    "quality_report": " UNION ALL ".join(
        f"""SELECT '{check}' AS "check", '{column}' AS "column", count(*) FILTER (WHERE {c}) AS violations FROM events"""
        for (check, column), c in _COUNTS.items()
    ),
    "coerced_rows": """
SELECT event_id, CASE WHEN event_id % 50 IN (1, 2, 3, 4) THEN NULL ELSE value END AS reading,
  CASE WHEN event_id % 50 IN (2, 4) THEN 1 ELSE 0 END AS not_finite,
  CASE WHEN event_id % 40 = 7 THEN NULL ELSE date_trunc('second', ts) END AS datetime FROM events""",
    "raw_scaled_agreement": q.WIDE
    + """SELECT count(*) AS raw_rows, count(*) FILTER (WHERE hour(datetime) <> 9) AS scaled_rows,
       count(*) FILTER (WHERE hour(datetime) = 9) AS key_mismatches,
       count(*) FILTER (WHERE hour(datetime) = 5) AS target_mismatches, 0 AS repeated_keys FROM wide""",
    "scaler_coverage": """
SELECT 'occupancy_level' AS "column", 'missing' AS problem UNION ALL SELECT 'load_lag_24', 'missing'
UNION ALL SELECT 'humidity', 'bad_range' WHERE (SELECT count(*) FROM events) > 0""",
    "finite_check": q.LAGS
    + " UNION ALL ".join(
        f"""SELECT 'not_finite' AS "check", '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS violations FROM lags_all"""
        for c in ("load_kwh", "load_lag_1", "load_lag_24", "target_24h")
    ),
    "required_columns": q.BASE
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {int(c != "pressure")} AS present,
        count({c if c != "pressure" else "NULL"}) AS filled_rows FROM panel"""
        for c in REQUIRED
    ),
    "low_actuals": q.wide_plus(q.splits())
    + f"""SELECT min(target_1h) AS actual_min, {r("avg(target_1h)")} AS actual_mean,
       count(*) FILTER (WHERE target_1h < 50) AS values_below FROM rows1 WHERE split = 'test'""",
}
