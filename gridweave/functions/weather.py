"""Weather-derived columns and physical limits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridweave.functions.guards import clip, flag
from gridweave.functions.text import Expr, add, num, put

# --- fixed values: thresholds and physical limits --------------------------------------
COOLING_ABOVE = 27.0
HEATING_BELOW = 18.0
HUMID_HOT_TEMPERATURE = 30.0
HUMID_HOT_HUMIDITY = 75.0
HEAVY_RAIN = 10.0
CLOUDY = 85.0
DARK_FROM, DARK_UNTIL = 18, 5
PHYSICAL_LIMITS = {"rain": (0.0, None), "humidity": (0.0, 100.0), "cloud_cover": (0.0, 100.0)}


def dark(hour: Expr) -> Expr:
    return f"({hour} >= {DARK_FROM} OR {hour} <= {DARK_UNTIL})"


def clamp_physical(df: DataFrame) -> DataFrame:
    return put(df, {c: clip(c, lo, hi) for c, (lo, hi) in PHYSICAL_LIMITS.items()})


def add_weather_features(df: DataFrame) -> DataFrame:
    """Degrees, flags and the temperature-humidity product; needs ``hour``."""
    return add(
        df,
        {
            "cooling_degree": clip(f"apparent_temperature - {num(COOLING_ABOVE)}", lo=0),
            "heating_degree": clip(f"{num(HEATING_BELOW)} - apparent_temperature", lo=0),
            "humid_hot": flag(
                f"temperature >= {num(HUMID_HOT_TEMPERATURE)} AND humidity >= {num(HUMID_HOT_HUMIDITY)}"
            ),
            "rainy_hour": flag("rain > 0"),
            "heavy_rain": flag(f"rain >= {num(HEAVY_RAIN)}"),
            "dark_or_cloudy": flag(f"{dark('hour')} OR cloud_cover >= {num(CLOUDY)}"),
            "temp_humidity_interaction": "temperature * humidity",
        },
    )
