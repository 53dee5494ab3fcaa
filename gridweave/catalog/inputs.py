"""Frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.catalog.sql import PRINT_MARGIN
from gridweave.functions.calendar import add_calendar
from gridweave.functions.text import Expr, col, num, put
from gridweave.functions.weather import add_weather_features, clamp_physical
from gridweave.operators.holidays import mark_holidays
from gridweave.operators.series import Series, add_lag_block, rows_bound
from gridweave.plans import panel, preprocess, wide
from gridweave.session import scratch_path
from gridweave.sources.tables import read_table

# the tables cover January 2024, so the split dates move there
TRAIN_END = "2024-01-23 00:00:00"
VALIDATION_START = "2024-01-16 00:00:00"
PANEL_SERIES = Series()
DIGITS = 6


def printed(e: Expr, digits: int = DIGITS) -> Expr:
    """A double cut to some digits for comparison with another engine.

    Rounds with a small margin: means of decimals often end in an exact 5, and the last bit of a
    sum, which depends on its order, would then decide the printed digit.
    """
    factor = num(10**digits)
    return f"(rint(({e}) * {factor} + {num(PRINT_MARGIN)}) / {factor} + 0.0D)"


def rounded(df: DataFrame, columns: list[str], digits: int = DIGITS) -> DataFrame:
    """Computed doubles to a fixed number of digits, so that both engines print the same."""
    order = df.columns
    return put(df, {c: printed(col(c), digits) for c in columns}).selectExpr(*map(col, order))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def hourly_bound(spark: SparkSession, sf: str) -> int:
    """Hours between the first and last event: the longest any hourly series can be."""
    return rows_bound(events(spark, sf), "ts")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return panel.hourly_panel(events(spark, sf))


def panel_features(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with calendar and weather columns."""
    return add_weather_features(add_calendar(mark_holidays(clamp_physical(hourly(spark, sf)))))


def panel_lags(spark: SparkSession, sf: str, drop_incomplete: bool = True) -> DataFrame:
    return add_lag_block(
        hourly(spark, sf), PANEL_SERIES, bound=hourly_bound(spark, sf), drop_incomplete=drop_incomplete
    )


def households(spark: SparkSession, sf: str) -> DataFrame:
    """Weather features per household profile."""
    return wide.household_rows(wide.clean_weather(panel.hourly_weather(events(spark, sf)), bound=hourly_bound(spark, sf)))


def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    return wide.wide_from_events(spark, events(spark, sf))


def stored_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table written once to the shared folder; the passes that follow only scan it."""
    path = scratch_path(spark, "wide")
    wide_table(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def prepared(spark: SparkSession, sf: str, horizon: str = "1h", stored: DataFrame | None = None) -> preprocess.Prepared:
    return preprocess.prepare(stored_wide(spark, sf) if stored is None else stored, horizon, TRAIN_END)
