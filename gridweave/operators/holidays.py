"""Holiday flag: closed date intervals against timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.fixed_values import HOLIDAYS
from gridweave.functions.text import add, any_of, col, constant_rows

BROADCAST_DATES = 200_000


def holiday_intervals(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, [{"start_date": f"DATE'{a}'", "end_date": f"DATE'{b}'"} for a, b in HOLIDAYS])


def interval_dates(intervals: DataFrame) -> DataFrame:
    """Intervals to distinct dates, so the range join becomes an equi join."""
    valid = intervals.filter("start_date <= end_date")
    return valid.selectExpr("explode(sequence(start_date, end_date, INTERVAL 1 DAY)) AS _holiday").distinct()


def mark_holidays(df: DataFrame, intervals: DataFrame | None = None, ts: str = "datetime") -> DataFrame:
    """Adds ``holiday_effect``: 1 when the day of ``ts`` lies in any interval.

    The fixed calendar is a constant condition of the projection. A calendar given as a table
    joins on the date; it is broadcast only when its counted size is small.
    """
    if intervals is None:
        day = f"to_date({col(ts)})"
        hit = any_of(f"{day} BETWEEN DATE'{a}' AND DATE'{b}'" for a, b in HOLIDAYS)
        return add(df, {"holiday_effect": f"int(coalesce({hit}, false))"})
    dates = interval_dates(intervals)
    if dates.count() <= BROADCAST_DATES:
        dates = F.broadcast(dates)
    joined = df.join(dates, F.expr(f"to_date({col(ts)}) = _holiday"), "left")
    return add(joined, {"holiday_effect": "int(_holiday IS NOT NULL)"}).drop("_holiday")
