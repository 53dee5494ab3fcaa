"""Missing values as null and NaN, and windows that reach beyond a chunk of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.catalog.evaluation import metrics_sql
from gridweave.catalog.sql import r
from gridweave.functions.calendar import hour_start
from gridweave.functions.errors import METRICS
from gridweave.functions.text import add, put
from gridweave.operators import evaluate
from gridweave.operators.dedup import keep_first
from gridweave.operators.gapfill import dense_grid, interpolate
from gridweave.operators.quality import removed_row_count
from gridweave.operators.scaling import minmax_stats
from gridweave.operators.series import add_lag_block

KEY = ["series_id", "datetime"]


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    """Events of which every eleventh has NaN for its reading and every thirteenth null."""
    reading = "CASE WHEN event_id % 11 = 0 THEN double('NaN') WHEN event_id % 13 <> 0 THEN value END"
    return add(i.events(spark, sf), {"reading": reading})


def invalid_rows_nan(spark: SparkSession, sf: str) -> DataFrame:
    return removed_row_count(_holes(spark, sf), ["reading"], "value")


def minmax_with_nan(spark: SparkSession, sf: str) -> DataFrame:
    return minmax_stats(_holes(spark, sf), ["reading", "value"])


def gap_fill_nan(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth hour is NaN; filled without a row bound, in buckets of 64 hours."""
    panel = i.hourly(spark, sf).select(*KEY, "load_kwh")
    holes = put(panel, {"load_kwh": "CASE WHEN hour(datetime) % 5 = 2 THEN double('NaN') ELSE load_kwh END"})
    return i.rounded(interpolate(dense_grid(holes, i.PANEL_SERIES), i.PANEL_SERIES, ["load_kwh"], bucket_steps=64), ["load_kwh"])


def dedup_first_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest reading of every type and hour; missing readings only where there is no other."""
    rows = _holes(spark, sf).selectExpr("event_type", f"{hour_start('ts')} AS datetime", "reading", "event_id")
    return keep_first(rows, ["event_type", "datetime"], ["reading", "event_id"])


def regression_metrics_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics per series where every fourth hour has no prediction."""
    lags = put(i.panel_lags(spark, sf), {"load_rolling_3": "CASE WHEN hour(datetime) % 4 <> 1 THEN load_rolling_3 END"})
    return i.rounded(evaluate.metrics(lags, "load_kwh", "load_rolling_3", ["series_id"]), list(METRICS))


def lag_year_split_series(spark: SparkSession, sf: str) -> DataFrame:
    """A lag and a lead longer than the chunks that the series are cut into."""
    lagged = add_lag_block(
        i.hourly(spark, sf), i.PANEL_SERIES, lags={"lag_100": 100}, leads={"next_90": 90}, rolling={"rolling_80": 80}, bound=None, chunk_rows=64
    )
    return lagged.select(*KEY, "load_kwh", "lag_100", "next_90", "rolling_80")


QUERIES = {
    f.__name__: f
    for f in (invalid_rows_nan, minmax_with_nan, gap_fill_nan, dedup_first_nulls, regression_metrics_missing, lag_year_split_series)
}

_READING = "CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN value END"
_SCORED = metrics_sql("load_kwh", "load_rolling_3")

ORACLE = {
    "invalid_rows_nan": f"""SELECT count(*) AS rows_before, count(*) - count({_READING}) AS removed_rows, count({_READING}) AS rows_after FROM events""",
    "minmax_with_nan": " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", min({e}) AS "min", max({e}) AS "max", max({e}) - min({e}) AS "range" FROM events"""
        for name, e in (("reading", _READING), ("value", "value"))
    ),
    "gap_fill_nan": q.BASE
    + f""",
hours AS (SELECT series_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM panel GROUP BY 1),
grid AS (SELECT hours.series_id, hours.datetime, CASE WHEN hour(hours.datetime) % 5 <> 2 THEN load_kwh END AS v,
                row_number() OVER (PARTITION BY hours.series_id ORDER BY hours.datetime) AS pos
         FROM hours LEFT JOIN panel USING (series_id, datetime)),
near AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER up AS b, min(CASE WHEN v IS NOT NULL THEN pos END) OVER down AS a FROM grid
         WINDOW up AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                down AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n.series_id, n.datetime, {r("CASE WHEN a = b THEN x.v WHEN b IS NULL THEN y.v WHEN a IS NULL THEN x.v ELSE x.v + (n.pos - b) * (y.v - x.v) / (a - b) END")} AS load_kwh
FROM near n LEFT JOIN grid x ON x.series_id = n.series_id AND x.pos = n.b LEFT JOIN grid y ON y.series_id = n.series_id AND y.pos = n.a""",
    "dedup_first_nulls": f"""
WITH numbered AS (SELECT event_type, date_trunc('hour', ts) AS datetime, {_READING} AS reading, event_id,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY {_READING} NULLS LAST, event_id) AS rn FROM events)
SELECT event_type, datetime, reading, event_id FROM numbered WHERE rn = 1""",
    "regression_metrics_missing": q.LAGS
    + f"SELECT series_id, {', '.join(f'{r(e)} AS {m}' for m, e in _SCORED.items())} FROM lags WHERE hour(datetime) % 4 <> 1 GROUP BY series_id",
    "lag_year_split_series": q.BASE
    + f""", lagged AS (
  SELECT series_id, datetime, load_kwh, lag(load_kwh, 100) OVER w AS lag_100, lead(load_kwh, 90) OVER w AS next_90,
         sum(CAST(round_even(load_kwh * 1e4, 0) AS BIGINT)) OVER (w ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING) AS s
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY datetime))
SELECT series_id, datetime, load_kwh, {q.half_even("lag_100", 4)} AS lag_100, {q.half_even("next_90", 4)} AS next_90,
       round_even(CAST(s AS DOUBLE) / 8e1, 0) / 1e4 AS rolling_80
FROM lagged WHERE lag_100 IS NOT NULL AND next_90 IS NOT NULL""",
}
