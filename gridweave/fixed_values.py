"""Fixed values of the data model. They must equal the published ones for right results."""

# --- fixed values: household profiles -------------------------------------------------
PROFILE_COLUMNS = (
    "profile_code",
    "profile_name",
    "household_size",
    "base_load_kw",
    "appliance_scale",
    "ac_sensitivity",
    "home_workday",
    "home_weekend",
    "evening_activity",
    "cooking_scale",
    "spike_scale",
)
PROFILES = (
    (0, "single_worker", 1, 0.11, 0.75, 0.75, 0.10, 0.68, 0.85, 0.55, 0.75),
    (1, "student", 1, 0.10, 0.65, 0.60, 0.42, 0.72, 1.05, 0.40, 0.65),
    (2, "family_3", 3, 0.18, 1.05, 0.95, 0.22, 0.78, 0.95, 1.00, 1.05),
    (3, "family_4_wfh", 4, 0.24, 1.25, 1.10, 0.58, 0.82, 1.00, 1.15, 1.20),
)

# --- fixed values: holiday intervals, both ends included ------------------------------
HOLIDAYS = (
    ("2021-01-01", "2021-01-01"),
    ("2021-02-10", "2021-02-16"),
    ("2021-04-30", "2021-05-03"),
    ("2021-09-02", "2021-09-03"),
    ("2022-01-01", "2022-01-03"),
    ("2022-01-31", "2022-02-04"),
    ("2022-04-30", "2022-05-03"),
    ("2022-09-01", "2022-09-04"),
    ("2023-01-01", "2023-01-02"),
    ("2023-01-20", "2023-01-26"),
    ("2023-04-29", "2023-05-03"),
    ("2023-09-01", "2023-09-04"),
    ("2024-01-01", "2024-01-01"),
    ("2024-02-08", "2024-02-14"),
    ("2024-04-30", "2024-05-01"),
    ("2024-09-02", "2024-09-03"),
    ("2025-01-01", "2025-01-01"),
    ("2025-01-25", "2025-02-02"),
    ("2025-04-30", "2025-05-01"),
    ("2025-09-02", "2025-09-03"),
)

# --- fixed values: column lists -------------------------------------------------------
WEATHER_COLUMNS = (
    "temperature",
    "humidity",
    "apparent_temperature",
    "rain",
    "wind_speed",
    "cloud_cover",
)
# source field of the weather payload -> column
PAYLOAD_FIELDS = {
    "time": "datetime",
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "apparent_temperature": "apparent_temperature",
    "rain": "rain",
    "wind_speed_10m": "wind_speed",
    "cloud_cover": "cloud_cover",
}
META_COLUMNS = ("datetime", "profile_code", "profile_name")
CORE_FEATURES = (
    "apparent_temperature",
    "humidity",
    "hour_sin",
    "hour_cos",
    "occupancy_level",
    "load_lag_24",
)
EXTENDED_FEATURES = (
    "household_size",
    "temperature",
    "humidity",
    "apparent_temperature",
    "rain",
    "wind_speed",
    "cloud_cover",
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
    "month_sin",
    "month_cos",
    "is_weekend",
    "holiday_effect",
    "usage_period",
    "working_hour",
    "sleep_hour",
    "morning_peak",
    "evening_peak",
    "meal_activity",
    "school_vacation",
    "cooling_degree",
    "heating_degree",
    "humid_hot",
    "rainy_hour",
    "heavy_rain",
    "dark_or_cloudy",
    "occupancy_share",
    "occupancy_level",
    "load_lag_1",
    "load_lag_24",
    "load_rolling_3",
    "load_rolling_24",
)
DIAGNOSTIC_COLUMNS = (
    "laundry_activity",
    "cooking_spike",
    "appliance_spike",
    "ac_startup_spike",
    "outage_anomaly",
)
LAG_COLUMNS = (
    "load_lag_1",
    "load_lag_24",
    "load_rolling_3",
    "load_rolling_24",
    "target_1h",
    "target_24h",
)
TARGETS = {"1h": "target_1h", "24h": "target_24h"}
FEATURE_SETS = {"core": CORE_FEATURES, "extended": EXTENDED_FEATURES}
CORRELATION_COLUMNS = WEATHER_COLUMNS + (
    "occupancy_level",
    "load_lag_1",
    "load_lag_24",
    "load_kwh",
)
WIDE_COLUMNS = (
    "datetime",
    "profile_code",
    "profile_name",
    "household_size",
    "temperature",
    "humidity",
    "apparent_temperature",
    "rain",
    "wind_speed",
    "cloud_cover",
    "hour",
    "day_of_week",
    "day_of_year",
    "month",
    "season_code",
    "is_weekend",
    "is_workday",
    "holiday_effect",
    "usage_period",
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
    "month_sin",
    "month_cos",
    "sleep_hour",
    "morning_peak",
    "evening_peak",
    "working_hour",
    "breakfast_hour",
    "lunch_hour",
    "dinner_hour",
    "meal_activity",
    "school_vacation",
    "cooling_degree",
    "heating_degree",
    "humid_hot",
    "rainy_hour",
    "heavy_rain",
    "dark_or_cloudy",
    "temp_humidity_interaction",
    "occupancy_share",
    "occupancy_level",
    "laundry_activity",
    "cooking_spike",
    "appliance_spike",
    "ac_startup_spike",
    "outage_anomaly",
    "load_lag_1",
    "load_lag_24",
    "load_rolling_3",
    "load_rolling_24",
    "load_kwh",
    "target_1h",
    "target_24h",
)

# --- fixed values: split dates, scaling limits, model defaults ------------------------
TRAIN_END = "2025-01-01 00:00:00"
VALIDATION_START = "2024-01-01 00:00:00"
FEATURE_CLIP = (-0.25, 1.25)
TARGET_CLIP = (0.0, 1.25)
LOAD_DECIMALS = 4
SHARE_DECIMALS = 3
PLOT_DAYS = 14
HISTOGRAM_BINS = 50
RIDGE_ALPHA = 1e-4
N_MFS = 2
MIN_SIGMA = 0.10
EPS = 1e-12
METRIC_EPS = 1e-8
SEED = 20260527
TREE_SEED = 42
PARITY_TOLERANCE = 1e-8
