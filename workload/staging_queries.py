"""Staging tables, marts and the joins, windows and filters they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.operators import ordered, quality, reshape
from noonwatt.plans import marts, staging
from workload.ctes import local
from workload.registry import register

TS = "utc_timestamp"
HISTORY = " ".join(vocab.HISTORY_FEATURES)
WEATHER = " ".join(c for c in vocab.NATIONAL_FEATURES if c not in ("ghi_min", "ghi_max"))
CYCLES = "hour_sin hour_cos day_of_year_sin day_of_year_cos"
MART = f"{vocab.TARGET} {CYCLES} {WEATHER} {HISTORY} {vocab.BENCHMARK}"
GENERATION = " ".join(vocab.GENERATION_COLUMNS.values())
OPERATORS = " ".join(vocab.OPERATOR_FORECAST_COLUMNS.values())


@register("mart_solar_features", "mart", MART)
def mart_solar_features(t):
    return t.mart


@register("agg_price_hourly", "stg_price", "price_eur_mwh")
def agg_price_hourly(t):
    return t.stg_price


@register("agg_generation_pivot", "stg_generation", GENERATION)
def agg_generation_pivot(t):
    return t.stg_generation


@register("agg_tso_pivot", "stg_tso", OPERATORS)
def agg_tso_pivot(t):
    return t.stg_tso


@register("agg_capacity_pivot", "stg_capacity")
def agg_capacity_pivot(t):
    return t.stg_capacity


@register("agg_device_pivot", "per_device", " ".join(vocab.DEVICE_COLUMNS.values()))
def agg_device_pivot(t):
    return staging.device_energy(t.stg_household)


@register(
    "agg_location_pivot",
    f"SELECT zone, utc_timestamp, {', '.join(vocab.LOCATION_FEATURES)} FROM stg_weather_national",
)
def agg_location_pivot(t):
    return t.stg_weather.groupBy("zone", TS).agg(*staging.location_columns())


@register(
    "agg_weather_national",
    f"SELECT zone, utc_timestamp, {', '.join(vocab.NATIONAL_FEATURES)}, locations_reporting "
    "FROM stg_weather_national",
    WEATHER,
)
def agg_weather_national(t):
    return t.stg_weather_national.drop(*vocab.LOCATION_FEATURES)


@register("agg_channel_p99", "channel_scale", "p99_kwh")
def agg_channel_p99(t):
    return staging.channel_scale(t.stored("metered"), exact=True)


@register("agg_price_mean_hour", "price_hourly", "price_eur_mwh")
def agg_price_mean_hour(t):
    return t.price_hourly


# --- joins ----------------------------------------------------------------------


@register(
    "join_month_capacity",
    f"SELECT g.zone, g.utc_timestamp, g.solar_mw, "
    f"CAST(date_trunc('month', {local('g.utc_timestamp')}) AS DATE) AS local_month, "
    "c.capacity_mw AS reported_capacity_mw FROM daily_generation g LEFT JOIN raw_installed_power c "
    f"ON date_trunc('month', {local('g.utc_timestamp')}) = c.month",
)
def join_month_capacity(t):
    return staging.month_capacity(t.daily_generation, t.monthly_capacity)


@register(
    "join_weather_inner",
    "SELECT s.zone, s.utc_timestamp, s.solar_mw, w.ghi_mean, w.ghi_max FROM stg_solar s "
    "JOIN stg_weather_national w USING (utc_timestamp)",
    "ghi_mean",
)
def join_weather_inner(t):
    weather = t.stg_weather_national.select("zone", TS, "ghi_mean", "ghi_max")
    return t.stg_solar.select("zone", TS, "solar_mw").join(weather, ["zone", TS])


@register(
    "join_benchmark_left",
    "SELECT s.zone, s.utc_timestamp, s.solar_mw, f.solar_forecast_mw AS tso_solar_forecast_mw, "
    "f.load_forecast_mw FROM stg_generation s LEFT JOIN stg_tso f USING (utc_timestamp)",
)
def join_benchmark_left(t):
    published = t.stg_tso.select(
        "zone", TS, F.col("solar_forecast_mw").alias("tso_solar_forecast_mw"), "load_forecast_mw"
    )
    return t.stg_generation.select("zone", TS, "solar_mw").join(published, ["zone", TS], "left")


@register(
    "join_channel_scale",
    "SELECT d.channel, d.utc_timestamp, d.energy_kwh, s.p99_kwh FROM differenced d "
    "LEFT JOIN channel_scale s USING (channel)",
    "energy_kwh p99_kwh",
)
def join_channel_scale(t):
    energy = t.stored("metered").select("channel", TS, "energy_kwh")
    scale = staging.channel_scale(energy, exact=True)
    return ordered.join_small(energy, scale, ["channel"], "left")


@register(
    "join_interval_self",
    "SELECT a.zone, a.utc_timestamp, a.capacity_factor_lag_48h, b.solar_capacity_factor AS actual "
    "FROM mart a JOIN mart b ON b.utc_timestamp = a.utc_timestamp - INTERVAL 48 HOUR",
    "capacity_factor_lag_48h actual",
)
def join_interval_self(t):
    return quality.earlier_value(t.stored("mart"), "capacity_factor_lag_48h", vocab.TARGET, 48)


@register(
    "antijoin_coverage",
    "SELECT w.zone, w.utc_timestamp FROM stg_weather_national w LEFT JOIN stg_generation g "
    "USING (utc_timestamp) WHERE g.utc_timestamp IS NULL AND w.utc_timestamp BETWEEN "
    "(SELECT min(utc_timestamp) FROM stg_generation) AND "
    "(SELECT max(utc_timestamp) FROM stg_generation)",
)
def antijoin_coverage(t):
    """Weather hours inside the generation range that have no generation."""
    hours = t.stg_weather_national.select("zone", TS)
    return quality.uncovered_hours(hours, t.stored("stg_generation"))


# --- windows --------------------------------------------------------------------


@register(
    "win_prev_reading",
    "SELECT channel, utc_timestamp, meter_kwh, previous_kwh, previous_timestamp FROM readings",
)
def win_prev_reading(t):
    seen = ordered.previous_row(
        t.stored("raw_household"), ["channel"], TS, {"previous_kwh": "meter_kwh", "previous_timestamp": TS}
    )
    return seen.select("channel", TS, "meter_kwh", "previous_kwh", "previous_timestamp")


@register(
    "win_meter_diff",
    "SELECT channel, utc_timestamp, meter_kwh, energy_kwh, is_implausible FROM stg_household",
    "energy_kwh",
)
def win_meter_diff(t):
    metered = staging.household(t.stored("raw_household"), exact=True, store=t.keep)
    return metered.select("channel", TS, "meter_kwh", "energy_kwh", "is_implausible")


@register(
    "win_carry_forward",
    "SELECT zone, utc_timestamp, reported_capacity_mw, last_value(reported_capacity_mw IGNORE NULLS)"
    " OVER (ORDER BY utc_timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS solar_ac_mw"
    " FROM (SELECT g.zone, g.utc_timestamp, c.capacity_mw AS reported_capacity_mw "
    "FROM daily_generation g LEFT JOIN raw_installed_power c "
    f"ON date_trunc('month', {local('g.utc_timestamp')}) = c.month)",
)
def win_carry_forward(t):
    """The hour-grain form; staging fills at month grain and must agree."""
    hours = t.keep(staging.month_capacity(t.daily_generation, t.monthly_capacity))
    filled = ordered.carry_forward(hours, ["zone"], TS, {"solar_ac_mw": "reported_capacity_mw"})
    return filled.select("zone", TS, "reported_capacity_mw", "solar_ac_mw")


@register(
    "win_cf_lags",
    "SELECT zone, utc_timestamp, capacity_factor_lag_48h, capacity_factor_lag_72h, "
    "capacity_factor_lag_168h FROM lagged",
    "capacity_factor_lag_48h capacity_factor_lag_72h capacity_factor_lag_168h",
    lagged="SELECT *, lag(solar_capacity_factor, 48) OVER w AS capacity_factor_lag_48h, "
    "lag(solar_capacity_factor, 72) OVER w AS capacity_factor_lag_72h, "
    "lag(solar_capacity_factor, 168) OVER w AS capacity_factor_lag_168h FROM stg_solar "
    "WINDOW w AS (ORDER BY utc_timestamp)",
)
def win_cf_lags(t):
    lagged = marts.with_history(t.stored("stg_solar"), ["zone"], vocab.TARGET, marts.SOLAR_LAGS, {})
    return lagged.select("zone", TS, *marts.SOLAR_LAGS)


def _mean_sql(name: str, first: int, table: str) -> str:
    return (
        f"SELECT zone, utc_timestamp, avg(solar_capacity_factor) OVER (ORDER BY utc_timestamp "
        f"ROWS BETWEEN {first} PRECEDING AND 48 PRECEDING) AS {name} FROM {table}"
    )


def _mean(df, name):
    means = {name: marts.SOLAR_MEANS[name]}
    return marts.with_history(df, ["zone"], vocab.TARGET, {}, means).select("zone", TS, name)


@register(
    "win_cf_mean_7d", _mean_sql("capacity_factor_mean_7d", 215, "stg_solar"),
    "capacity_factor_mean_7d",
)
def win_cf_mean_7d(t):
    return _mean(t.stored("stg_solar"), "capacity_factor_mean_7d")


@register(
    "win_cf_mean_30d", _mean_sql("capacity_factor_mean_30d", 767, "stg_solar_daily"),
    "capacity_factor_mean_30d",
)
def win_cf_mean_30d(t):
    """Over the seven-year series, so that the whole frame fills."""
    return _mean(t.stored("stg_solar_daily"), "capacity_factor_mean_30d")


@register(
    "win_load_lags",
    "SELECT building, utc_timestamp, consumption_lag_48h, consumption_lag_168h FROM mart_household",
    "consumption_lag_48h consumption_lag_168h",
)
def win_load_lags(t):
    usable = t.stored("stg_household_load").where(F.col("consumption_kwh") >= 0)
    lagged = marts.with_history(usable, ["building"], "consumption_kwh", marts.LOAD_LAGS, {})
    return lagged.select("building", TS, *marts.LOAD_LAGS)


@register(
    "win_load_mean_7d",
    "SELECT building, utc_timestamp, consumption_mean_7d FROM mart_household",
    "consumption_mean_7d",
)
def win_load_mean_7d(t):
    usable = t.stored("stg_household_load").where(F.col("consumption_kwh") >= 0)
    lagged = marts.with_history(usable, ["building"], "consumption_kwh", {}, marts.LOAD_MEANS)
    return lagged.select("building", TS, *marts.LOAD_MEANS)


@register("win_latest_issue", "latest_issue")
def win_latest_issue(t):
    return reshape.latest_per_key(t.prediction_log, ["zone", TS], ["issued_at", "model_name"])


@register(
    "win_step_minutes",
    "SELECT zone, utc_timestamp, date_diff('minute', lag(utc_timestamp) OVER "
    "(ORDER BY utc_timestamp), utc_timestamp) AS step_minutes FROM stg_generation",
)
def win_step_minutes(t):
    return ordered.gap_minutes(t.stored("stg_generation").select("zone", TS), ["zone"])


@register(
    "win_rolling_time",
    "SELECT zone, utc_timestamp, avg(solar_capacity_factor) OVER (ORDER BY utc_timestamp RANGE "
    "BETWEEN INTERVAL 167 HOUR PRECEDING AND CURRENT ROW) AS mean_7d, avg(solar_capacity_factor) "
    "OVER (ORDER BY utc_timestamp RANGE BETWEEN INTERVAL 719 HOUR PRECEDING AND CURRENT ROW) "
    "AS mean_30d FROM stg_solar",
    "mean_7d mean_30d",
)
def win_rolling_time(t):
    rolled = ordered.rolling_hours(
        t.stored("stg_solar"), ["zone"], TS, vocab.TARGET, {"mean_7d": 168, "mean_30d": 720}
    )
    return rolled.select("zone", TS, "mean_7d", "mean_30d")


@register(
    "win_shift_24h",
    "SELECT zone, utc_timestamp, price_eur_mwh, lag(price_eur_mwh, 24) OVER "
    "(ORDER BY utc_timestamp) AS decision_price_eur_mwh FROM stg_price",
    "price_eur_mwh decision_price_eur_mwh",
)
def win_shift_24h(t):
    shifted = ordered.trailing_rows(
        t.stored("stg_price"), ["zone"], TS,
        {"decision_price_eur_mwh": ("price_eur_mwh", vocab.NAIVE_PRICE_LAG_HOURS)},
    )
    return shifted.select("zone", TS, "price_eur_mwh", "decision_price_eur_mwh")


# --- composite models -------------------------------------------------------------


@register("stg_solar_output", "stg_solar_daily", "solar_capacity_factor:12")
def stg_solar_output(t):
    return t.stg_solar_daily


@register("stg_household", "stg_household", "energy_kwh")
def stg_household(t):
    return t.stg_household


@register(
    "stg_household_load", "stg_household_load",
    " ".join(c for c in [*vocab.DEVICE_COLUMNS.values(), "consumption_kwh"]),
)
def stg_household_load(t):
    return t.stg_household_load


@register(
    "mart_household_features", "mart_household",
    " ".join(
        c
        for c in ["consumption_kwh", "grid_import_kwh", "pv_kwh", "heat_pump_kwh", "ev_kwh",
                  *marts.LOAD_LAGS, *marts.LOAD_MEANS]
    ) + " " + CYCLES,
)
def mart_household_features(t):
    return t.mart_household


# --- projections and filters --------------------------------------------------------


@register(
    "weather_leads",
    "SELECT zone, utc_timestamp, location, latitude, longitude, temperature_c_day_ahead, "
    "ghi_wm2_day_ahead, direct_radiation_wm2_day_ahead, diffuse_radiation_wm2_day_ahead, "
    "cloud_cover_pct_day_ahead, temperature_c, ghi_wm2, direct_radiation_wm2, "
    "diffuse_radiation_wm2, cloud_cover_pct FROM raw_weather",
)
def weather_leads(t):
    return t.stg_weather


@register(
    "select_except",
    "SELECT * EXCLUDE (utc_timestamp, locations_reporting) FROM stg_weather_national",
    WEATHER,
)
def select_except(t):
    return reshape.drop_columns(t.stg_weather_national, TS, "locations_reporting")


@register(
    "feature_select",
    f"SELECT zone, utc_timestamp, {', '.join(vocab.FEATURES)} FROM mart",
    f"{CYCLES} {WEATHER} {HISTORY}",
)
def feature_select(t):
    return marts.model_inputs(t.mart, ["zone", TS])


@register("drop_incomplete", "frame", MART)
def drop_incomplete(t):
    return t.frame


@register(
    "plausible_rows",
    "SELECT utc_timestamp, building, consumption_kwh FROM stg_household_load "
    "WHERE consumption_kwh IS NOT NULL AND consumption_kwh >= 0",
    "consumption_kwh",
)
def plausible_rows(t):
    return t.stg_household_load.where(F.col("consumption_kwh") >= 0).select(
        TS, "building", "consumption_kwh"
    )


@register(
    "daylight_filter",
    "SELECT zone, utc_timestamp, ghi_max, ghi_mean FROM stg_weather_national WHERE ghi_max > 0",
    "ghi_mean",
)
def daylight_filter(t):
    return marts.daylight(t.stg_weather_national).select("zone", TS, "ghi_max", "ghi_mean")


@register(
    "time_slice",
    "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' "
    "AND ts < TIMESTAMP '2024-01-17 00:00:00'",
)
def time_slice(t):
    """A half-open week; the bounds reach the Parquet scan."""
    from noonwatt.functions.calendar import instant

    week = reshape.time_slice(
        t.given("events"), instant("2024-01-10 00:00:00"), instant("2024-01-17 00:00:00"), order="ts"
    )
    return week.select("event_id", "ts", "value")


@register(
    "entity_filter",
    "SELECT utc_timestamp, local_datetime, consumption_kwh FROM mart_household "
    "WHERE building = 'residential4'",
    "consumption_kwh",
)
def entity_filter(t):
    from noonwatt.operators.profile import building_rows

    return building_rows(t.mart_household).select(TS, "local_datetime", "consumption_kwh")


@register(
    "clip_unit",
    "SELECT zone, utc_timestamp, greatest(0.0, least(1.0, price_eur_mwh / 100)) AS clipped "
    "FROM raw_price",
    "clipped",
)
def clip_unit(t):
    from noonwatt.functions.numbers import clip_unit as clip

    return t.raw_price.select("zone", TS, clip(F.col("price_eur_mwh") / 100).alias("clipped"))


@register(
    "clean_zero",
    "SELECT zone, utc_timestamp, round(CASE WHEN abs(x) < 1e-9 THEN 0.0 ELSE x END, 6) + 0.0 "
    "AS cleaned FROM (SELECT zone, utc_timestamp, "
    "CASE WHEN price_eur_mwh < 0 THEN price_eur_mwh * 1e-12 ELSE price_eur_mwh / 7 END AS x "
    "FROM raw_price)",
)
def clean_zero(t):
    from noonwatt.functions.numbers import watts_clean

    noisy = F.when(F.col("price_eur_mwh") < 0, F.col("price_eur_mwh") * 1e-12).otherwise(
        F.col("price_eur_mwh") / 7
    )
    return t.raw_price.select("zone", TS, watts_clean(noisy).alias("cleaned"))


@register(
    "derived_flags",
    "SELECT l.utc_timestamp, l.building, l.has_pv, dayofweek(l.local_datetime) IN (0, 6) "
    "AS is_weekend FROM stg_household_load l",
)
def derived_flags(t):
    from noonwatt.functions.calendar import is_weekend

    return t.stg_household_load.select(
        TS, "building", "has_pv", is_weekend("local_datetime").alias("is_weekend")
    )
