"""Split, scaling and projection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.catalog import inputs as i
from gridweave.catalog import sql as q
from gridweave.catalog.sql import r
from gridweave.fixed_values import CORE_FEATURES, EXTENDED_FEATURES, META_COLUMNS
from gridweave.functions.text import add, col, select
from gridweave.operators.scaling import feature_columns, minmax_stats, scaled, unscaled
from gridweave.operators.splits import add_fit_split, add_split, split_rows, subset, train_test
from gridweave.operators.summary import split_summary, target_stats

CORE, EXTENDED = list(CORE_FEATURES), list(EXTENDED_FEATURES)
STATS = ["min", "max", "range"]


def minmax_statistics(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    return i.rounded(minmax_stats(train, [*q.ALL_FEATURES, "target_1h"]), STATS)


def scaled_core(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(i.prepared(spark, sf).scaled("core"), [*CORE, "target_1h_scaled"])


def scaled_extended(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(i.prepared(spark, sf, "24h").scaled("extended"), [*EXTENDED, "target_24h_scaled"])


def raw_core(spark: SparkSession, sf: str) -> DataFrame:
    return i.rounded(i.prepared(spark, sf).raw("core"), CORE[:4])


def inverse_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Back from scaled to raw units: equal to the input wherever nothing was clipped."""
    p = i.prepared(spark, sf)
    both = p.rows.selectExpr(
        *select(
            ["profile_code", "datetime"],
            {
                "lag_back": unscaled(scaled("load_lag_24", p.stats), "load_lag_24", p.stats),
                "target_back": unscaled(scaled(p.target, p.stats, (0.0, 1.25)), p.target, p.stats),
            },
        )
    )
    return i.rounded(both, ["lag_back", "target_back"])


def split_summaries(spark: SparkSession, sf: str) -> DataFrame:
    wide = add_split(i.wide_table(spark, sf), i.TRAIN_END)
    both = split_summary(wide, "target_1h", "1h").unionByName(split_summary(wide, "target_24h", "24h"))
    return i.rounded(both, ["target_mean", "target_std"])


def test_target_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, test = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    return i.rounded(target_stats(test, "target_24h"), ["mean", "std"])


def fit_split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(add_fit_split(i.wide_table(spark, sf), i.VALIDATION_START, i.TRAIN_END))


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Features left after dropping keys and targets, as one array per row."""
    p = i.prepared(spark, sf)
    frame = p.scaled("core")
    names = feature_columns(frame, p.target)
    digits = ", ".join(i.printed(col(c)) for c in names)
    return frame.selectExpr("profile_code", "datetime", f"array_join(transform(array({digits}), x -> format_string('%.6f', x)), ' ') AS x", "target_1h AS y")


def subset_by_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Validation rows: keys, features and both targets stay aligned."""
    p = i.prepared(spark, sf)
    rows = add_fit_split(p.scaled("core", extra={}), i.VALIDATION_START, i.TRAIN_END)
    return i.rounded(subset(rows, "split = 'validation'").drop("split"), [*CORE, "target_1h_scaled"])


def profile_filter(spark: SparkSession, sf: str) -> DataFrame:
    """One profile, chosen by comparing text."""
    wide = i.wide_table(spark, sf).filter("string(profile_code) = '2'")
    return add(wide.select("datetime", "profile_name", "load_kwh"), {"time_text": "date_format(datetime, 'yyyy-MM-dd HH:mm:ss')"})


QUERIES = {
    f.__name__: f
    for f in (
        minmax_statistics, scaled_core, scaled_extended, raw_core, inverse_scaled, split_summaries,
        test_target_stats, fit_split_rows, feature_matrix, subset_by_mask, profile_filter,
    )
}

_ALL = [*q.ALL_FEATURES, "target_1h", "target_24h"]
_META = ", ".join(META_COLUMNS)
_SCALED = q.wide_plus(q.splits(), q.stats(_ALL))


def _scaled_list(names: list[str]) -> str:
    return ", ".join(f"{r(q.scaled(c))} AS {c}" for c in names)


def _target(t: str) -> str:
    return f"{t}, {r(q.scaled(t, 0.0, 1.25))} AS {t}_scaled"


ORACLE = {
    "minmax_statistics": q.wide_plus(q.splits())
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f"min({c})")} AS "min", {r(f"max({c})")} AS "max",
        {r(f"CASE WHEN max({c}) = min({c}) THEN 1 ELSE max({c}) - min({c}) END")} AS "range" FROM rows1 WHERE split = 'train'"""
        for c in [*q.ALL_FEATURES, "target_1h"]
    ),
    "scaled_core": _SCALED + f"SELECT {_META}, {_scaled_list(CORE)}, {_target('target_1h')}, split FROM rows1, st",
    "scaled_extended": _SCALED + f"SELECT {_META}, {_scaled_list(EXTENDED)}, {_target('target_24h')}, split FROM rows1, st",
    "raw_core": q.wide_plus(q.splits())
    + f"SELECT {_META}, {', '.join(f'{r(c)} AS {c}' for c in CORE[:4])}, occupancy_level, load_lag_24, target_1h, split FROM rows1",
    "inverse_scaled": _SCALED
    + f"""SELECT profile_code, datetime, {r(q.scaled("load_lag_24") + " * span_load_lag_24 + lo_load_lag_24")} AS lag_back,
       {r(q.scaled("target_1h", 0.0, 1.25) + " * span_target_1h + lo_target_1h")} AS target_back FROM rows1, st""",
    "split_summaries": q.wide_plus(q.splits())
    + " UNION ALL ".join(
        f"""SELECT '{h}' AS horizon, '{t}' AS target_column, coalesce(split, 'all') AS split, count(*) AS rows,
        min(datetime) AS start_datetime, max(datetime) AS end_datetime, {r(f"avg({t})")} AS target_mean,
        {r(f"stddev_samp({t})")} AS target_std, min({t}) AS target_min, max({t}) AS target_max
        FROM rows1 GROUP BY GROUPING SETS ((split), ())"""
        for h, t in (("1h", "target_1h"), ("24h", "target_24h"))
    ),
    "test_target_stats": q.wide_plus(q.splits())
    + f"""SELECT count(*) AS rows, min(datetime) AS start, max(datetime) AS "end", count(DISTINCT profile_code) AS profile_count,
       min(target_24h) AS "min", max(target_24h) AS "max", {r("avg(target_24h)")} AS "mean", {r("stddev_pop(target_24h)")} AS std
       FROM rows1 WHERE split = 'test'""",
    "fit_split_rows": q.wide_plus(q.splits()) + "SELECT fit_split AS split, count(*) AS rows FROM rows1 GROUP BY 1",
    "feature_matrix": _SCALED
    + "SELECT profile_code, datetime, "
    + " || ' ' || ".join(f"printf('%.6f', {r(q.scaled(c))})" for c in CORE)
    + " AS x, target_1h AS y FROM rows1, st",
    "subset_by_mask": _SCALED
    + f"SELECT {_META}, {_scaled_list(CORE)}, {_target('target_1h')} FROM rows1, st WHERE fit_split = 'validation'",
    "profile_filter": q.WIDE
    + """SELECT datetime, profile_name, load_kwh, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS time_text
       FROM wide WHERE profile_code = 2""",
}
