"""Names and constants shared by every layer.

Everything in this file is a fixed value: it has to equal what the landed data
and the published results use, so it is written out as plain text.
"""

# Market calendar and gate.
MARKET_TZ = "Europe/Berlin"
GATE_HOUR = 12
LEAD_DAYS = 1
PRICES_PUBLISHED_HOUR = 13
HORIZON_HOURS = (12, 36)
COMPLETE_HOUR_INTERVALS = (1, 4)
HOURS_PER_DAY = 24
DAYS_PER_YEAR = 365.25

# First dates with usable data.
DATA_START = "2022-01-01"
WEATHER_START = "2024-01-01"
WEATHER_ARCHIVE_START = "2022-01-01"
DAY_AHEAD_RADIATION_START = "2024-01-19"
QUARTER_HOURLY_FROM = "2025-10-01"

# Sampled weather points, name -> (latitude, longitude).
LOCATIONS = {
    "hamburg": (53.55, 9.99),
    "rostock": (54.09, 12.14),
    "hanover": (52.37, 9.73),
    "berlin": (52.52, 13.40),
    "cologne": (50.94, 6.96),
    "kassel": (51.31, 9.49),
    "nuremberg": (49.45, 11.08),
    "stuttgart": (48.78, 9.18),
    "munich": (48.14, 11.58),
}

# Weather payload variable -> column.
WEATHER_VARIABLES = {
    "temperature_2m": "temperature_c",
    "shortwave_radiation": "ghi_wm2",
    "direct_radiation": "direct_radiation_wm2",
    "diffuse_radiation": "diffuse_radiation_wm2",
    "cloud_cover": "cloud_cover_pct",
}
PREVIOUS_DAY_SUFFIX = "_previous_day1"
DAY_AHEAD_SUFFIX = "_day_ahead"

# Series names in the landed payloads -> staging columns.
GENERATION_COLUMNS = {
    "Solar": "solar_mw",
    "Wind onshore": "wind_onshore_mw",
    "Wind offshore": "wind_offshore_mw",
    "Load": "load_mw",
    "Residual load": "residual_load_mw",
}
OPERATOR_FORECAST_COLUMNS = {
    "solar": "solar_forecast_mw",
    "load": "load_forecast_mw",
    "wind_onshore": "wind_onshore_forecast_mw",
    "wind_offshore": "wind_offshore_forecast_mw",
}
CAPACITY_COLUMNS = {
    "Solar AC": "solar_ac_mw",
    "Solar DC": "solar_dc_mw",
    "Wind onshore": "wind_onshore_mw",
    "Wind offshore": "wind_offshore_mw",
    "Battery storage (power)": "battery_power_mw",
    "Battery storage (capacity)": "battery_energy_mwh",
}
DEVICE_COLUMNS = {
    "grid_import": "grid_import_kwh",
    "grid_export": "grid_export_kwh",
    "pv": "pv_kwh",
    "heat_pump": "heat_pump_kwh",
    "ev": "ev_kwh",
}

# Household channel naming, <prefix><building><n>_<device>.
CHANNEL_PREFIX = "DE_KN_"
CHANNEL_PATTERN = r"^DE_KN_(([a-z]+)\d*)_(.+)$"
DEFAULT_BUILDING = "residential4"

# Meter plausibility, kWh.
PLAUSIBLE_FACTOR = 50.0
PLAUSIBLE_FLOOR_KWH = 1.0

# Model inputs, in order.
LOCATION_FEATURES = [
    "ghi_hamburg",
    "ghi_rostock",
    "ghi_hanover",
    "ghi_berlin",
    "ghi_cologne",
    "ghi_kassel",
    "ghi_nuremberg",
    "ghi_stuttgart",
    "ghi_munich",
]
NATIONAL_FEATURES = [
    "ghi_mean",
    "ghi_min",
    "ghi_max",
    "ghi_stddev",
    "ghi_spread",
    "direct_radiation_mean",
    "diffuse_radiation_mean",
    "temperature_mean",
    "cloud_cover_mean",
    "cloud_cover_stddev",
]
CALENDAR_FEATURES = [
    "hour_of_day",
    "day_of_week",
    "day_of_year",
    "month_of_year",
    "hour_sin",
    "hour_cos",
    "day_of_year_sin",
    "day_of_year_cos",
]
HISTORY_FEATURES = [
    "capacity_factor_lag_48h",
    "capacity_factor_lag_72h",
    "capacity_factor_lag_168h",
    "capacity_factor_mean_7d",
    "capacity_factor_mean_30d",
]
WEATHER_FEATURES = LOCATION_FEATURES + NATIONAL_FEATURES
FEATURES = WEATHER_FEATURES + CALENDAR_FEATURES + HISTORY_FEATURES

# In the mart, never a model input.
NEVER_FEATURES = [
    "solar_mw",
    "solar_ac_mw",
    "tso_solar_forecast_mw",
    "tso_solar_forecast_capacity_factor",
    "gate_utc",
    "horizon_hours",
    "utc_timestamp",
    "local_datetime",
]
TARGET = "solar_capacity_factor"
BENCHMARK = "tso_solar_forecast_capacity_factor"

# Gate-safe history, hours.
LAG_HOURS = (48, 72, 168)
GATE_SAFE_OFFSET = 48
MEAN_7D_HOURS = 168
MEAN_30D_HOURS = 720

# Model settings.
RIDGE_ALPHA = 1.0
GBT_TREES = 400
GBT_STEP = 0.05
GBT_MIN_LEAF = 40
GBT_SEED = 0

# Default home battery and fallback draw.
BATTERY_ENERGY_MWH = 0.010
BATTERY_POWER_MW = 0.005
BATTERY_ROUND_TRIP = 0.90
FLAT_LOAD_MW = 0.0004
SYSTEM_KWP = 10.0
NAIVE_PRICE_LAG_HOURS = 24

# The sentences of a day's advice.
ADVICE = {
    "prices": "Cheapest power at %s; dearest at %s.",
    "charge": "Charge from the grid around %s.",
    "discharge": "Discharge around %s.",
    "solar": "Solar peaks near %02d:00 at %.1f kW.",
    "benefit": "Expected benefit on %s: EUR %.2f (%.2f from the battery, %.2f from solar offsetting purchases).",
}
