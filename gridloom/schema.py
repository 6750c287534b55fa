"""Columns of the readings table and the values that define it."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

RAW_SCHEMA = T.StructType(
    [
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("hour", _I),
        T.StructField("season", _S),
        T.StructField("region", _S),
        T.StructField("city", _S),
        T.StructField("event", _S),
        T.StructField("temperature", _D),
        T.StructField("humidity", _D),
        T.StructField("voltage", _D),
        T.StructField("frequency", _D),
        T.StructField("transformer_temp", _D),
        T.StructField("total_load_mw", _D),
        T.StructField("available_power_mw", _D),
        T.StructField("outage_risk", _D),
        T.StructField("renewable_power_mw", _D),
        T.StructField("industrial_load", _D),
        T.StructField("residential_load", _D),
        T.StructField("commercial_load", _D),
        T.StructField("population_density", _D),
        T.StructField("smart_meter_count", _L),
        T.StructField("load_shedding_mw", _D),
        T.StructField("energy_price", _D),
        T.StructField("fuel_cost", _D),
        T.StructField("blackout", _I),
        T.StructField("overload", _I),
    ]
)

# ---------------------------------------------------------------------------
# Physical limits, cut points, labels, feature lists, places.
# They must equal the published ones for results to agree.
# ---------------------------------------------------------------------------

PHYSICAL_BOUNDS = {
    "temperature": (15.0, 50.0),
    "humidity": (0.0, 100.0),
    "total_load_mw": (0.0, 1000.0),
    "available_power_mw": (0.0, 1000.0),
    "voltage": (180.0, 260.0),
    "frequency": (47.0, 53.0),
    "transformer_temp": (20.0, 120.0),
    "outage_risk": (0.0, 100.0),
}

NOMINAL_VOLTAGE = 220.0
NOMINAL_FREQUENCY = 50.0
NO_EVENT = "No Event"
PEAK_HOURS = (6, 7, 8, 17, 18, 19, 20, 21)

TIME_OF_DAY = ((5, "Nuit"), (11, "Matin"), (17, "Après-midi"), (20, "Soir"), (23, "Nuit tardive"))
RISK_LABELS = ((30, "Faible"), (60, "Modéré"), (80, "Élevé"), (100, "Critique"))
MAP_RISK = ((75, "CRITIQUE", "#E63946"), (50, "ELEVE", "#F4A261"), (30, "MODERE", "#E9C46A"), (0, "FAIBLE", "#2A9D8F"))
SCORE_LEVELS = ((0.75, "CRITIQUE"), (0.50, "ELEVE"), (0.25, "MODERE"), (0.0, "FAIBLE"))

CATEGORY_COLUMNS = ("region", "city", "season", "event")
ENCODED_COLUMNS = ("region", "city", "season", "event", "time_of_day")
LAGS = (1, 3, 6, 12, 24)
ROLLING = (3, 6, 24)

UNSCALED_COLUMNS = (
    "blackout", "overload", "is_weekend", "is_peak_hour",
    "year", "month", "day", "hour", "day_of_week", "day_of_year", "week", "quarter",
)

BLACKOUT_FEATURES = (
    "temperature", "humidity", "total_load_mw", "available_power_mw",
    "renewable_power_mw", "transformer_temp", "voltage", "frequency",
    "outage_risk", "load_ratio", "power_margin", "power_margin_pct",
    "grid_stress_index", "voltage_deviation", "frequency_deviation",
    "industrial_share", "residential_share", "commercial_share",
    "renewable_share", "is_peak_hour", "is_weekend",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos",
    "load_lag_1h", "load_lag_3h", "load_lag_6h", "load_lag_24h",
    "outage_risk_lag_1h", "outage_risk_lag_6h",
    "load_roll_mean_3h", "load_roll_mean_24h",
    "load_roll_std_6h", "risk_roll_max_6h", "risk_roll_max_24h",
    "region_enc", "city_enc", "season_enc", "event_enc",
    "population_density", "smart_meter_count",
)

OVERLOAD_FEATURES = (
    "temperature", "humidity", "total_load_mw", "available_power_mw",
    "industrial_load", "residential_load", "commercial_load",
    "transformer_temp", "voltage", "frequency",
    "load_ratio", "power_margin", "grid_stress_index",
    "is_peak_hour", "is_weekend", "hour_sin", "hour_cos",
    "month_sin", "month_cos", "dow_sin", "dow_cos",
    "load_lag_1h", "load_lag_6h", "load_roll_mean_6h", "load_roll_std_6h",
    "region_enc", "city_enc", "season_enc", "event_enc",
    "population_density",
)

RISK_FEATURES = (
    "temperature", "humidity", "total_load_mw", "available_power_mw",
    "transformer_temp", "voltage", "frequency",
    "load_ratio", "power_margin_pct", "grid_stress_index",
    "voltage_deviation", "frequency_deviation",
    "is_peak_hour", "is_weekend", "hour_sin", "hour_cos",
    "load_lag_1h", "load_lag_6h", "outage_risk_lag_1h",
    "load_roll_mean_3h", "risk_roll_max_6h",
    "region_enc", "city_enc", "season_enc", "event_enc",
)

DEMAND_FEATURES = (
    "temperature", "humidity",
    "hour", "day_of_week", "month", "is_weekend", "is_peak_hour",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos",
    "load_lag_1h", "load_lag_3h", "load_lag_6h", "load_lag_24h",
    "load_roll_mean_3h", "load_roll_mean_6h", "load_roll_mean_24h",
    "load_roll_std_6h",
    "region_enc", "city_enc", "season_enc", "event_enc",
    "population_density", "renewable_share",
)

ANOMALY_FEATURES = (
    "temperature", "total_load_mw", "available_power_mw",
    "transformer_temp", "voltage", "frequency",
    "outage_risk", "load_ratio", "grid_stress_index",
    "voltage_deviation", "frequency_deviation",
    "power_margin", "renewable_share",
)

LIVE_ANOMALY_FEATURES = (
    "total_load_mw", "available_power_mw", "transformer_temp",
    "voltage", "frequency", "outage_risk",
)

TASKS = {
    "blackout_prediction": (BLACKOUT_FEATURES, "blackout", "binary_classification"),
    "overload_prediction": (OVERLOAD_FEATURES, "overload", "binary_classification"),
    "risk_classification": (RISK_FEATURES, "risk_level", "multiclass_classification"),
    "demand_forecasting": (DEMAND_FEATURES, "total_load_mw", "regression"),
}

CORRELATION_COLUMNS = {
    "energy": (
        "temperature", "humidity", "total_load_mw", "available_power_mw",
        "renewable_power_mw", "transformer_temp", "voltage", "frequency",
        "outage_risk", "load_shedding_mw", "energy_price", "blackout", "overload",
    ),
    "explore": (
        "temperature", "humidity", "total_load_mw", "available_power_mw",
        "transformer_temp", "voltage", "frequency", "outage_risk",
        "load_shedding_mw", "energy_price", "fuel_cost", "blackout", "overload",
    ),
    "live": (
        "temperature", "humidity", "total_load_mw", "available_power_mw",
        "transformer_temp", "voltage", "frequency", "outage_risk", "blackout",
    ),
}

CITY_COORDS = (
    ("Lome", 6.1375, 1.2123),
    ("Kpalime", 6.8999, 0.6244),
    ("Atakpame", 7.5833, 1.1333),
    ("Sokode", 8.9833, 1.1333),
    ("Kara", 9.5511, 1.1861),
    ("Dapaong", 10.8623, 0.2061),
    ("Tsevie", 6.4271, 1.2189),
)

REGION_CENTROIDS = (
    ("Maritime", 6.30, 1.30),
    ("Plateaux", 7.20, 0.90),
    ("Centrale", 8.65, 1.15),
    ("Kara", 9.55, 1.19),
    ("Savanes", 10.50, 0.30),
    ("Lome", 6.14, 1.21),
)

DEFAULT_COORDS = (6.14, 1.21)
