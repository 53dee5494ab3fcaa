"""Weather and load tables to the wide feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.fixed_values import WEATHER_COLUMNS, WIDE_COLUMNS
from gridweave.functions.calendar import add_calendar
from gridweave.functions.household import add_occupancy
from gridweave.functions.weather import add_weather_features, clamp_physical
from gridweave.operators.dedup import keep_first
from gridweave.operators.gapfill import interpolate
from gridweave.operators.holidays import mark_holidays
from gridweave.operators.profiles import fan_out, profile_table
from gridweave.operators.quality import DataQualityError, require_columns
from gridweave.operators.series import Series, add_lag_block, rows_bound
from gridweave.plans.panel import CELL, household_cells, weather_of_cells
from gridweave.session import stored

HOUSEHOLD = Series(keys=("profile_code",))
# eleven years of hours, about 40 MB of features
BROADCAST_HOURS = 100_000


def clean_weather(
    weather: DataFrame, series: Series = Series(keys=()), bound: int | None = None, unique: bool = False
) -> DataFrame:
    """Required columns, first row per hour, gaps filled, physical limits applied.

    ``unique`` says that no hour repeats. With a proven ``bound`` of at most a million rows a series is
    filled in one task; without one it is cut into buckets.
    """
    require_columns(weather, ["datetime", *WEATHER_COLUMNS], "weather")
    first = weather if unique else keep_first(weather, [*series.keys, series.time], [series.time])
    if not series.keys:
        # a single long series has no key: give it one so that it can be cut into chunks
        keyed = first.withColumn("_series", F.lit(0))
        filled = interpolate(keyed, Series(("_series",), series.time, series.step), list(WEATHER_COLUMNS), bound=bound)
        filled = filled.drop("_series")
    else:
        filled = interpolate(first, series, list(WEATHER_COLUMNS), bound=bound)
    return clamp_physical(filled)


def add_features(weather: DataFrame) -> DataFrame:
    """Calendar, habit and weather features: projections only, computed before the profile fan-out."""
    return add_weather_features(add_calendar(mark_holidays(weather)))


def household_rows(weather: DataFrame) -> DataFrame:
    """Feature rows per profile with the share of the household at home."""
    return add_occupancy(fan_out(add_features(weather)))


def require_unique_hours(features: DataFrame) -> None:
    """Several feature rows per hour would multiply the loads, and their number has no bound."""
    rows, hours = features.selectExpr("count(*)", "count(DISTINCT datetime)").first()
    if rows != hours:
        raise DataQualityError(f"features: {rows} rows for {hours} hours")


def build_wide(
    features: DataFrame, load: DataFrame, *, bound: int | None = None, unique_hours: bool = False
) -> DataFrame:
    """The wide table: one row per profile and hour that has a load, lags and both targets.

    ``features`` holds one row per hour (see ``add_features``), which is checked unless ``unique_hours``
    says so; ``load`` carries profile_code,
    datetime, load_kwh and the diagnostic flags. The lag windows run on the narrow load rows, so
    the one wide shuffle moves eight columns instead of fifty; the features are looked up
    afterwards. They are broadcast while the proven number of hours is small; beyond that, or
    without a bound, Spark joins on the hour. Load rows without weather are left out first,
    because lags count rows.
    """
    if not unique_hours:
        require_unique_hours(features)
    if bound is not None and bound <= BROADCAST_HOURS:
        features = F.broadcast(features)
    profiles = F.broadcast(profile_table(load.sparkSession))  # four constant rows
    covered = load.join(features.select("datetime"), "datetime", "left_semi")
    covered = covered.join(profiles.select("profile_code"), "profile_code", "left_semi")
    lagged = add_lag_block(covered, HOUSEHOLD, bound=bound)
    rows = lagged.join(features, "datetime").join(profiles, "profile_code")
    return add_occupancy(rows).select(*WIDE_COLUMNS)


def wide_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Weather and loads from one event table.

    The events are read once, into a small table of profiles and hours from which everything else comes.
    """
    cells = stored(household_cells(events), "cells")
    bound = rows_bound(cells, "datetime")
    features = add_features(clean_weather(weather_of_cells(cells), bound=bound, unique=True))
    return build_wide(features, cells.drop(*CELL), bound=bound, unique_hours=True)
