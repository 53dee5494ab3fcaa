"""Regular panels from event-like and order-like tables.

Each is one grouped aggregate with map-side combining: a series that holds a third of the
events still reduces to one partial row per task and cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.fixed_values import DIAGNOSTIC_COLUMNS, LOAD_DECIMALS, PROFILES
from gridweave.functions.calendar import day_start, hour_of_day
from gridweave.functions.guards import half_even, nan_to_null, settled
from gridweave.functions.text import Expr, add, quote, select

# event type -> diagnostic flag column of the load table
FLAG_EVENTS = dict(zip(("view", "click", "purchase", "signup", "error"), DIAGNOSTIC_COLUMNS))


def load_sum(value: Expr) -> Expr:
    """Sum of doubles, of which only the result is rounded; NaN is missing, infinity stays."""
    return half_even(settled(f"sum({value})"), LOAD_DECIMALS)


# Weather stand-ins of one cell of events; ``_k`` is the number in ``props``.
WEATHER = {
    "temperature": "(min(value) + max(value)) / 2.0D",
    "humidity": "double(sum(_k)) / count(_k)",
    "apparent_temperature": f"{settled('sum(value)')} / count(value)",
    "rain": "double(min(_k))",
    "wind_speed": "double(count(*))",
    "cloud_cover": "double(max(_k))",
}
K_OF_PROPS = "try_cast(get_json_object(props, '$.k') AS BIGINT)"


def grouped(df: DataFrame, keys: list[str], aggregates: dict[str, Expr]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])


def _hourly(events: DataFrame, keys: dict[str, Expr], aggregates: dict[str, Expr]) -> DataFrame:
    """Groups by date and hour number; the timestamp is put together once per cell, not per event."""
    cells = add(nan_to_null(events), {**keys, "_day": "to_date(ts)", "_hour": "hour(ts)", "_k": K_OF_PROPS})
    grid = grouped(cells, [*keys, "_day", "_hour"], aggregates)
    return grid.selectExpr(*select(keys, {"datetime": hour_of_day("_day", "_hour")}), *aggregates)


def hourly_panel(events: DataFrame) -> DataFrame:
    """Series per event type and hour."""
    values = {"load_kwh": load_sum("value"), **WEATHER, "occupancy_level": "count(DISTINCT user_id)"}
    return _hourly(events, {"series_id": "event_type"}, values)


def hourly_weather(events: DataFrame) -> DataFrame:
    """One weather row per hour, without a series key."""
    return _hourly(events, {}, WEATHER)


def hourly_load(events: DataFrame) -> DataFrame:
    """Load and event flags per household profile and hour."""
    flags = {name: f"max(int(event_type = {quote(kind)}))" for kind, name in FLAG_EVENTS.items()}
    profile = f"int(user_id % {len(PROFILES)})"
    return _hourly(events, {"profile_code": profile}, {"load_kwh": load_sum("value"), **flags})


# Partial weather of one profile and hour; ``WEATHER_OF_CELLS`` puts the profiles of an hour together.
CELL = {
    "_sum": "sum(value)", "_count": "count(value)", "_min": "min(value)", "_max": "max(value)", "_rows": "count(*)",
    "_k_sum": "sum(_k)", "_k_count": "count(_k)", "_k_min": "min(_k)", "_k_max": "max(_k)",
}
WEATHER_OF_CELLS = {
    "temperature": "(min(_min) + max(_max)) / 2.0D",
    "humidity": "double(sum(_k_sum)) / sum(_k_count)",
    "apparent_temperature": f"{settled('sum(_sum)')} / sum(_count)",
    "rain": "double(min(_k_min))",
    "wind_speed": "double(sum(_rows))",
    "cloud_cover": "double(max(_k_max))",
}


def household_cells(events: DataFrame) -> DataFrame:
    """Load, event flags and partial weather per household profile and hour: the events are read once."""
    flags = {name: f"max(int(event_type = {quote(kind)}))" for kind, name in FLAG_EVENTS.items()}
    profile = f"int(user_id % {len(PROFILES)})"
    return _hourly(events, {"profile_code": profile}, {"load_kwh": load_sum("value"), **flags, **CELL})


def weather_of_cells(cells: DataFrame) -> DataFrame:
    """One weather row per hour from ``household_cells``."""
    return grouped(cells, ["datetime"], WEATHER_OF_CELLS)


def user_hour_panel(events: DataFrame) -> DataFrame:
    """Series per user and hour: many sparse series."""
    return _hourly(events, {"series_id": "user_id"}, {"load_kwh": load_sum("value")})


def supplier_daily_panel(lineitem: DataFrame) -> DataFrame:
    """Series per supplier and shipping day."""
    days = add(nan_to_null(lineitem), {"series_id": "l_suppkey", "_day": "to_date(l_shipdate)"})
    grid = grouped(days, ["series_id", "_day"], {"load_kwh": load_sum("l_quantity")})
    return grid.selectExpr("series_id", f"{day_start('_day')} AS datetime", "load_kwh")
