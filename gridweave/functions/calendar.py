"""Date parts, cyclic encodings and hour-of-day classes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridweave.functions.guards import flag
from gridweave.functions.text import Expr, add, col, num

# --- fixed values: cycle lengths, seasons, hour bands, meal weights --------------------
CYCLES = {"hour": ("hour", 24), "day": ("day_of_week", 7), "month": ("month", 12)}
SEASON_MONTHS = {0: (12, 1, 2), 1: (3, 4), 2: (5, 6, 7, 8, 9)}
SEASON_DEFAULT = 3
NIGHT = (0, 5)
HOUR_BANDS = {
    "morning_peak": (6, 8),
    "evening_peak": (18, 22),
    "breakfast_hour": (6, 7),
    "lunch_hour": (11, 12),
    "dinner_hour": (18, 20),
}
SLEEP_UNTIL, SLEEP_FROM = 5, 23
WORK_HOURS = (8, 17)
MEAL_WEIGHTS = {
    "breakfast_hour": 0.8,
    "lunch_hour": 0.5,
    "dinner_hour": 1.2,
    "holiday_effect": 0.25,
}
VACATION_MONTHS = (6, 7)


def between(e: Expr, limits: tuple[int, int]) -> Expr:
    """Closed at both ends."""
    return f"{e} BETWEEN {limits[0]} AND {limits[1]}"


def hour_start(ts: str) -> Expr:
    """Start of the hour as wall-clock time, whatever the session time zone is."""
    return f"make_timestamp_ntz(year({ts}), month({ts}), day({ts}), hour({ts}), 0, 0)"


def hour_of_day(day: Expr, hour: Expr) -> Expr:
    return f"make_timestamp_ntz(year({day}), month({day}), day({day}), {hour}, 0, 0)"


def day_start(ts: str) -> Expr:
    return f"CAST(to_date({ts}) AS TIMESTAMP_NTZ)"


def grid_index(ts: str, step: str) -> Expr:
    """Whole steps since 1970-01-01 on an hourly or daily grid."""
    days = f"bigint(unix_date(to_date({ts})))"
    if step == "day":
        return days
    if step == "hour":
        return f"({days} * 24 + hour({ts}))"
    raise ValueError(f"step must be 'hour' or 'day', not {step!r}")


def date_parts(ts: str) -> dict[str, Expr]:
    return {
        "hour": f"hour({ts})",
        "day_of_week": f"weekday({ts})",
        "day_of_year": f"dayofyear({ts})",
        "month": f"month({ts})",
        "is_weekend": flag(f"weekday({ts}) >= 5"),
    }


def cyclic(e: Expr, period: int) -> tuple[Expr, Expr]:
    angle = f"2.0D * pi() * {e} / {num(period)}"
    return f"sin({angle})", f"cos({angle})"


def season(month: Expr) -> Expr:
    branches = " ".join(f"WHEN {month} IN {months} THEN {code}" for code, months in SEASON_MONTHS.items())
    return f"CASE {branches} ELSE {SEASON_DEFAULT} END"


def usage_period(hour: Expr) -> Expr:
    """0 night, 2 morning or evening, 1 otherwise; the first match wins."""
    busy = f"{between(hour, HOUR_BANDS['morning_peak'])} OR {between(hour, HOUR_BANDS['evening_peak'])}"
    return f"CASE WHEN {between(hour, NIGHT)} THEN 0 WHEN {busy} THEN 2 ELSE 1 END"


def add_calendar(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """All calendar and habit columns. Needs ``holiday_effect`` (see operators.holidays)."""
    waves = {}
    for name, (source, period) in CYCLES.items():
        waves[f"{name}_sin"], waves[f"{name}_cos"] = cyclic(source, period)
    with_parts = add(df, date_parts(col(ts)))
    with_classes = add(
        with_parts,
        {
            **waves,
            "is_workday": flag("is_weekend = 0 AND holiday_effect = 0"),
            "season_code": season("month"),
            "sleep_hour": flag(f"hour <= {SLEEP_UNTIL} OR hour >= {SLEEP_FROM}"),
            **{name: flag(between("hour", band)) for name, band in HOUR_BANDS.items()},
            "school_vacation": flag(f"month IN {VACATION_MONTHS}"),
            "usage_period": usage_period("hour"),
        },
    )
    return add(
        with_classes,
        {
            "working_hour": flag(f"{between('hour', WORK_HOURS)} AND is_workday = 1"),
            "meal_activity": " + ".join(f"{num(weight)} * {name}" for name, weight in MEAL_WEIGHTS.items()),
        },
    )
