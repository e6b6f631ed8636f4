"""Summaries, sorts, set operations, column functions and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions import calendar as cal
from noonwatt.functions import numbers, text
from noonwatt.operators import explore, ordered, profile, quality, reshape, scoring
from noonwatt.plans import marts
from workload.ctes import calendar, gate, local
from workload.registry import register
from workload.staging_queries import CYCLES, MART

TS = "utc_timestamp"

# --- aggregations ---------------------------------------------------------------------


@register(
    "agg_hour_of_week",
    "SELECT building, (isodow(local_datetime) - 1) * 24 + hour(local_datetime) AS hour_of_week, "
    "avg(consumption_kwh) AS mean_kwh, count(*) AS cell_hours FROM mart_household GROUP BY ALL",
    "mean_kwh",
)
def agg_hour_of_week(t):
    fitted = profile.fit_profiles(t.mart_household)
    return fitted.select("building", "hour_of_week", "mean_kwh", "cell_hours")


@register(
    "agg_climatology",
    "SELECT zone, week, hour_of_day, avg(cf) AS mean_capacity_factor, count(*) AS hours, "
    "CAST(grouping(week) + grouping(hour_of_day) AS BIGINT) AS level FROM (SELECT zone, "
    "(dayofyear(local_datetime) - 1) // 7 AS week, hour(local_datetime) AS hour_of_day, "
    "solar_capacity_factor AS cf FROM stg_solar_daily WHERE solar_capacity_factor IS NOT NULL) "
    "GROUP BY GROUPING SETS ((zone, week, hour_of_day), (zone, hour_of_day), (zone))",
    "mean_capacity_factor:12",
)
def agg_climatology(t):
    from noonwatt.plans.forecast import climatology_cells

    train = t.stg_solar_daily.withColumns(
        {
            "day_of_year": F.dayofyear("local_datetime"),
            "hour_of_day": F.hour("local_datetime").cast("bigint"),
        }
    )
    return climatology_cells(train)


@register(
    "agg_score_summary",
    "SELECT zone, 'our forecast' AS source, avg(abs(predicted_capacity_factor - "
    "actual_capacity_factor)) AS mae, count(*) AS hours FROM scored WHERE ghi_mean_forecast > 0 "
    "GROUP BY zone UNION ALL SELECT zone, 'TSO forecast', avg(abs(tso_capacity_factor - "
    "actual_capacity_factor)), count(*) FROM scored WHERE ghi_mean_forecast > 0 "
    "AND tso_capacity_factor IS NOT NULL GROUP BY zone",
    "mae",
)
def agg_score_summary(t):
    return scoring.score_summary(scoring.score_log(t.prediction_log, t.stg_solar, t.stg_tso))


BY_DAY = (
    "SELECT zone, target_date, count(*) AS hours, avg(abs(predicted_capacity_factor - "
    "actual_capacity_factor)) AS mae, avg(predicted_capacity_factor - actual_capacity_factor) "
    "AS bias FROM scored WHERE ghi_mean_forecast > 0 GROUP BY zone, target_date"
)


@register("agg_score_by_day", BY_DAY, "mae bias")
def agg_score_by_day(t):
    return scoring.score_by_day(scoring.score_log(t.prediction_log, t.stg_solar, t.stg_tso))


PROFILE_CTES = {
    "prof_rows": "SELECT building, consumption_kwh, (isodow(local_datetime) - 1) * 24 + "
    "hour(local_datetime) AS hw FROM mart_household",
    "prof_cells": "SELECT building, hw, avg(consumption_kwh) AS mean_kwh FROM prof_rows "
    "GROUP BY building, hw",
    "prof_level": "SELECT building, avg(consumption_kwh) AS overall, count(*) AS n FROM prof_rows "
    "GROUP BY building",
}


@register(
    "agg_profile_score",
    "SELECT building, avg(abs(coalesce(mean_kwh, overall) - consumption_kwh)) AS profile_mae_kwh, "
    "avg(abs(overall - consumption_kwh)) AS flat_mae_kwh, count(*) AS hours, "
    "1 - avg(abs(coalesce(mean_kwh, overall) - consumption_kwh)) / "
    "nullif(avg(abs(overall - consumption_kwh)), 0) AS improvement FROM prof_rows "
    "JOIN prof_level USING (building) LEFT JOIN prof_cells USING (building, hw) GROUP BY building",
    "profile_mae_kwh flat_mae_kwh improvement",
    **PROFILE_CTES,
)
def agg_profile_score(t):
    return profile.score_profiles(
        t.stored("mart_household"), profile.fit_profiles(t.stored("mart_household"))
    )


DAY = f"CAST({local('utc_timestamp')} AS DATE)"
SPREAD = (
    f"SELECT zone, {DAY} AS day, max(price_eur_mwh) - min(price_eur_mwh) AS price_spread_eur_mwh "
    f"FROM price_hourly GROUP BY zone, {DAY} HAVING count(*) = 24"
)


@register("agg_daily_spread", SPREAD, "price_spread_eur_mwh")
def agg_daily_spread(t):
    return explore.daily_spread(t.price_hourly)


@register(
    "agg_annualise",
    "SELECT zone, count(*) AS days, sum(r) AS total_eur, avg(r) AS mean_daily_eur, avg(r) * 365.25 "
    "AS annual_eur, avg(e) / 0.01 AS cycles_per_day, avg(e) / 0.01 * 365.25 AS cycles_per_year "
    "FROM (SELECT zone, price_spread_eur_mwh * 0.01 AS r, price_spread_eur_mwh / 10000 AS e "
    "FROM day_spread) GROUP BY zone",
    "total_eur:6 mean_daily_eur:6 annual_eur:6 cycles_per_day:6 cycles_per_year:6",
    day_spread=SPREAD,
)
def agg_annualise(t):
    """One full cycle at the day's spread, scaled to a year."""
    daily = explore.daily_spread(t.price_hourly).select(
        "zone",
        (F.col("price_spread_eur_mwh") * 0.01).alias("revenue_eur"),
        (F.col("price_spread_eur_mwh") / 10000).alias("energy_cycled_mwh"),
        F.lit(0.01).alias("energy_mwh"),
    )
    return explore.annualise(daily, ["zone"])


HOURS = [f"h{h:02d}" for h in range(24)]


@register(
    "agg_month_hour",
    f"SELECT zone, month({local('utc_timestamp')}) AS month_of_year, "
    + ", ".join(
        f"avg(CASE WHEN hour({local('utc_timestamp')}) = {h} THEN mw END) AS h{h:02d}"
        for h in range(24)
    )
    + " FROM shipping_hours GROUP BY ALL",
    " ".join(HOURS),
)
def agg_month_hour(t):
    """Over seven years of hours, so that every month and clock change occurs."""
    return explore.month_by_hour(t.shipping_hours, "mw")


YEARLY = (
    "SELECT zone, year(local_datetime) AS year, avg(solar_ac_mw) / 1000 AS capacity_gw, "
    "avg(solar_mw) / 1000 AS generation_gw, avg(solar_capacity_factor) AS capacity_factor "
    "FROM stg_solar_daily GROUP BY zone, year(local_datetime)"
)


@register("agg_yearly", YEARLY, "capacity_gw:3 generation_gw:6 capacity_factor:12")
def agg_yearly(t):
    return explore.yearly(t.stg_solar_daily)


DESCRIBED = [vocab.TARGET, "ghi_mean", vocab.BENCHMARK]


@register(
    "agg_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
        f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM mart"
        for c in DESCRIBED
    ),
    "mean std min p25 p50 p75 max",
)
def agg_describe(t):
    return explore.describe(t.stored("mart"), DESCRIBED)


@register(
    "agg_corr",
    "SELECT zone, corr(ghi_mean, solar_capacity_factor) AS correlation, count(*) AS hours FROM mart "
    "WHERE ghi_max > 0 GROUP BY zone",
    "correlation",
)
def agg_corr(t):
    return explore.correlation(marts.daylight(t.mart), "ghi_mean", vocab.TARGET)


def _bin_sql(v: str, lo: str, hi: str, n: int) -> str:
    return f"CAST(least({n - 1}, floor(({v} - {lo}) * {n} / ({hi} - {lo}))) AS BIGINT)"


@register(
    "agg_histogram",
    f"SELECT zone, {_bin_sql('price_eur_mwh', 'lo', 'hi', 120)} AS bin, count(*) AS hours FROM "
    "stg_price CROSS JOIN (SELECT min(price_eur_mwh) AS lo, max(price_eur_mwh) AS hi FROM stg_price)"
    " GROUP BY ALL",
)
def agg_histogram(t):
    return explore.histogram(t.stored("stg_price"), "price_eur_mwh", 120)


@register(
    "agg_bin2d",
    f"SELECT zone, {_bin_sql('ghi_mean', 'xl', 'xh', 55)} AS x_bin, "
    f"{_bin_sql('solar_capacity_factor', 'yl', 'yh', 55)} AS y_bin, count(*) AS hours FROM daylit "
    "CROSS JOIN (SELECT min(ghi_mean) AS xl, max(ghi_mean) AS xh, min(solar_capacity_factor) AS yl, "
    "max(solar_capacity_factor) AS yh FROM daylit) GROUP BY ALL",
    daylit="SELECT zone, round(ghi_mean, 6) AS ghi_mean, solar_capacity_factor FROM mart "
    "WHERE ghi_max > 0",
)
def agg_bin2d(t):
    lit = marts.daylight(t.stored("mart")).withColumn("ghi_mean", F.round("ghi_mean", 6))
    return explore.density(lit, "ghi_mean", vocab.TARGET, 55)


@register(
    "agg_error_by_hour",
    "SELECT zone, hour_of_day, avg(abs(tso_solar_forecast_capacity_factor - solar_capacity_factor)) "
    "AS tso_error, avg(abs(capacity_factor_lag_48h - solar_capacity_factor)) AS lag_error, "
    "count(*) AS hours FROM mart WHERE ghi_max > 0 AND capacity_factor_lag_48h IS NOT NULL "
    "AND tso_solar_forecast_capacity_factor IS NOT NULL GROUP BY zone, hour_of_day",
    "tso_error lag_error",
)
def agg_error_by_hour(t):
    return explore.error_by_hour(t.mart)


SHAPE = (
    f"SELECT zone, hour({local('utc_timestamp')}) AS hour_of_day, avg(price_eur_mwh) "
    "AS mean_eur_mwh FROM stg_price GROUP BY ALL"
)


@register(
    "agg_price_shape",
    "SELECT zone, hour_of_day, mean_eur_mwh, max(mean_eur_mwh) OVER () - min(mean_eur_mwh) OVER () "
    "AS shape_range_eur_mwh FROM shape",
    "mean_eur_mwh shape_range_eur_mwh",
    shape=SHAPE,
)
def agg_price_shape(t):
    shape = explore.price_shape(t.stg_price)
    return shape.join(explore.shape_range(shape), "zone")


@register(
    "agg_negative_share",
    "SELECT zone, count(*) FILTER (price_eur_mwh < 0) AS negative_hours, count(*) AS hours, "
    "avg(CASE WHEN price_eur_mwh < 0 THEN 1.0 ELSE 0.0 END) AS negative_share FROM stg_price "
    "GROUP BY zone",
    "negative_share",
)
def agg_negative_share(t):
    return explore.negative_share(t.stg_price)


@register(
    "agg_daily_peak",
    "SELECT zone, count(*) AS days, max(peak) AS best, min(peak) AS worst, max(peak) / nullif(min(peak), 0) "
    "AS ratio FROM (SELECT zone, CAST(local_datetime AS DATE) AS day, max(solar_capacity_factor) "
    "AS peak FROM mart WHERE local_datetime >= TIMESTAMP '2024-01-08' "
    "AND local_datetime < TIMESTAMP '2024-01-22' GROUP BY ALL) GROUP BY zone",
    "best worst ratio",
)
def agg_daily_peak(t):
    """Two weeks of daily peaks: best day against worst."""
    weeks = reshape.time_slice(
        t.mart, cal.instant("2024-01-08"), cal.instant("2024-01-22"), order="local_datetime"
    )
    return explore.peak_ratio(explore.daily_peak(weeks))


@register(
    "agg_night_midday",
    "SELECT zone, avg(CASE WHEN hour(utc_timestamp) = 2 THEN solar_mw END) AS night_mw, "
    "avg(CASE WHEN hour(utc_timestamp) = 11 THEN solar_mw END) AS midday_mw FROM stg_generation "
    "GROUP BY zone",
    "night_mw midday_mw",
)
def agg_night_midday(t):
    return explore.night_and_midday(t.stg_generation)


@register(
    "agg_meter_summary",
    "SELECT building_type, count(*) AS rows_total, count(energy_kwh) AS with_energy, "
    "count(*) FILTER (is_implausible) AS flagged, max(meter_kwh) AS max_cumulative, "
    "max(CASE WHEN NOT is_implausible THEN energy_kwh END) AS max_hourly_kept, "
    "max(CASE WHEN is_implausible THEN energy_kwh END) AS max_hourly_flagged, "
    "min(energy_kwh) AS min_hourly FROM stg_household GROUP BY building_type",
    "max_hourly_kept max_hourly_flagged min_hourly",
)
def agg_meter_summary(t):
    return explore.meter_summary(t.stg_household)


COVERAGE = " UNION ALL ".join(
    f"SELECT '{name}' AS model, count(*) AS n, min(utc_timestamp) AS first_ts, "
    f"max(utc_timestamp) AS last_ts FROM {cte}"
    for name, cte in (
        ("stg_price", "stg_price"),
        ("stg_generation", "stg_generation"),
        ("stg_day_ahead_forecast", "stg_tso"),
    )
)


def _hourly_models(t):
    return {
        "stg_price": t.stg_price,
        "stg_generation": t.stg_generation,
        "stg_day_ahead_forecast": t.stg_tso,
    }


@register("agg_coverage", COVERAGE)
def agg_coverage(t):
    return quality.coverage(_hourly_models(t))


# --- sorts and top-k --------------------------------------------------------------------


@register("sort_output", "SELECT channel, utc_timestamp, meter_kwh FROM raw_household "
                         "ORDER BY channel, utc_timestamp")
def sort_output(t):
    """Sorted for presentation: a range-partitioned sort, not one task."""
    return t.raw_household.select("channel", TS, "meter_kwh").orderBy("channel", TS)


TOPK = (
    "SELECT zone, day, utc_timestamp, price_eur_mwh, kind FROM (SELECT zone, "
    f"{DAY} AS day, utc_timestamp, price_eur_mwh, 'cheapest' AS kind, row_number() OVER (PARTITION "
    f"BY zone, {DAY} ORDER BY price_eur_mwh, utc_timestamp) AS k FROM price_r UNION ALL SELECT "
    f"zone, {DAY}, utc_timestamp, price_eur_mwh, 'dearest', row_number() OVER (PARTITION BY zone, "
    f"{DAY} ORDER BY price_eur_mwh DESC, utc_timestamp) FROM price_r) WHERE k <= 3"
)
PRICE_R = "SELECT zone, utc_timestamp, round(price_eur_mwh, 6) AS price_eur_mwh FROM price_hourly"


@register("topk_hours", TOPK, price_r=PRICE_R)
def topk_hours(t):
    """The three cheapest and three dearest hours of every local day."""
    prices = t.stored("price_hourly").select(
        "zone", cal.market_date(TS).alias("day"), TS, F.round("price_eur_mwh", 6).alias("price_eur_mwh")
    )
    cheap = reshape.top_hours(prices, ["zone", "day"], "price_eur_mwh")
    dear = reshape.top_hours(prices, ["zone", "day"], "price_eur_mwh", dearest=True)
    return cheap.withColumn("kind", F.lit("cheapest")).unionByName(
        dear.withColumn("kind", F.lit("dearest"))
    )


@register(
    "latest_row",
    "SELECT zone, month, solar_ac_mw, solar_dc_mw FROM stg_capacity WHERE solar_ac_mw IS NOT NULL "
    "AND solar_dc_mw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone ORDER BY month DESC) = 1",
)
def latest_row(t):
    return explore.latest_capacity(t.stg_capacity)


@register(
    "argmax_row",
    f"SELECT zone, day, utc_timestamp, solar_mw FROM (SELECT zone, {DAY} AS day, utc_timestamp, "
    f"solar_mw, row_number() OVER (PARTITION BY zone, {DAY} ORDER BY solar_mw DESC, utc_timestamp) "
    "AS k FROM stg_generation) WHERE k = 1",
)
def argmax_row(t):
    days = t.stg_generation.select("zone", cal.market_date(TS).alias("day"), TS, "solar_mw")
    return reshape.first_at_peak(days, ["zone", "day"], "solar_mw")


# --- set operations -----------------------------------------------------------------------


@register(
    "union_sources",
    "SELECT zone, utc_timestamp, lower(replace(production_type, ' ', '_')) AS production_type, "
    "power_mw AS mw, 'measured' AS kind FROM raw_public_power UNION ALL SELECT zone, utc_timestamp, "
    "production_type, forecast_mw, 'published' FROM raw_day_ahead_forecast",
)
def union_sources(t):
    measured = t.raw_public_power.select(
        "zone", TS,
        F.lower(F.replace("production_type", F.lit(" "), F.lit("_"))).alias("production_type"),
        F.col("power_mw").alias("mw"), F.lit("measured").alias("kind"),
    )
    published = t.raw_day_ahead_forecast.select(
        "zone", TS, "production_type", F.col("forecast_mw").alias("mw"),
        F.lit("published").alias("kind"),
    )
    return reshape.union_all([measured, published])


@register(
    "union_coverage",
    COVERAGE + " UNION ALL SELECT 'stg_weather_national', count(*), min(utc_timestamp), "
    "max(utc_timestamp) FROM stg_weather_national UNION ALL SELECT 'stg_household', count(*), "
    "min(utc_timestamp), max(utc_timestamp) FROM stg_household",
)
def union_coverage(t):
    models = {
        **_hourly_models(t),
        "stg_weather_national": t.stg_weather_national,
        "stg_household": t.stg_household,
    }
    return quality.coverage(models)


EXPECTED_SERIES = ["Solar", "Wind onshore", "Wind offshore", "Load", "Residual load", "Nuclear"]


@register(
    "except_expected",
    "SELECT production_type FROM (VALUES "
    + ", ".join(f"('{s}')" for s in EXPECTED_SERIES)
    + ") e(production_type) EXCEPT SELECT production_type FROM raw_public_power",
)
def except_expected(t):
    """Expected series the raw table never delivers."""
    return quality.missing_names(EXPECTED_SERIES, t.raw_public_power, "production_type")


# --- column functions ------------------------------------------------------------------------


@register("fn_trunc_hour", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def fn_trunc_hour(t):
    return t.given("events").select("event_id", cal.hour_start("ts").alias("hour"))


@register(
    "fn_local_time",
    f"SELECT zone, utc_timestamp, {local('utc_timestamp')} AS local_datetime FROM shipping_hours",
)
def fn_local_time(t):
    return t.shipping_hours.select("zone", TS, cal.to_market(TS).alias("local_datetime"))


GATED = f"SELECT zone, utc_timestamp, {gate(local('utc_timestamp'))} AS gate_utc FROM shipping_hours"


@register("fn_gate", GATED)
def fn_gate(t):
    return t.shipping_hours.select("zone", TS, cal.gate(cal.to_market(TS)).alias("gate_utc"))


@register(
    "fn_ts_diff",
    "SELECT zone, utc_timestamp, date_diff('hour', gate_utc, utc_timestamp) AS horizon_hours, "
    "date_diff('minute', gate_utc, utc_timestamp) AS horizon_minutes FROM gated",
    gated=GATED,
)
def fn_ts_diff(t):
    gated = t.shipping_hours.select("zone", TS, cal.gate(cal.to_market(TS)).alias("gate_utc"))
    return gated.select(
        "zone",
        TS,
        cal.hours_between("gate_utc", TS).alias("horizon_hours"),
        cal.minutes_between("gate_utc", TS).alias("horizon_minutes"),
    )


def _calendar(t, names):
    cols = cal.calendar_columns(cal.to_market(TS))
    return t.shipping_hours.select("zone", TS, *[cols[n].alias(n) for n in names])


@register(
    "fn_calendar",
    f"SELECT zone, utc_timestamp, hour(l) AS hour_of_day, dayofweek(l) + 1 AS day_of_week, "
    f"dayofyear(l) AS day_of_year, month(l) AS month_of_year, year(l) AS year FROM (SELECT *, "
    f"{local('utc_timestamp')} AS l FROM shipping_hours)",
)
def fn_calendar(t):
    names = ["hour_of_day", "day_of_week", "day_of_year", "month_of_year"]
    return _calendar(t, names).withColumn("year", F.year(cal.to_market(TS)).cast("bigint"))


@register(
    "fn_cyclic",
    f"SELECT zone, utc_timestamp, {', '.join(CYCLES.split())} FROM (SELECT zone, utc_timestamp, "
    f"{calendar('l')} FROM (SELECT *, {local('utc_timestamp')} AS l FROM shipping_hours))",
    CYCLES,
)
def fn_cyclic(t):
    return _calendar(t, CYCLES.split())


@register(
    "fn_safe_divide",
    "SELECT utc_timestamp, location, CASE WHEN ghi_wm2_day_ahead = 0 THEN NULL ELSE ghi_wm2 / "
    "ghi_wm2_day_ahead END AS lead_ratio FROM raw_weather",
    "lead_ratio",
)
def fn_safe_divide(t):
    return t.raw_weather.select(
        TS, "location", numbers.ratio("ghi_wm2", "ghi_wm2_day_ahead").alias("lead_ratio")
    )


@register(
    "fn_null_logic",
    "SELECT channel, utc_timestamp, coalesce(energy_kwh > greatest(10 * coalesce(energy_kwh, 0), "
    "100.0), FALSE) AS beyond, coalesce(energy_kwh, 0) AS energy_or_zero, CASE WHEN meter_kwh > 2500 "
    "THEN 'high' ELSE 'low' END AS level FROM differenced",
    "energy_or_zero",
)
def fn_null_logic(t):
    energy = F.coalesce("energy_kwh", F.lit(0.0))
    limit = F.greatest(energy * 10, F.lit(100.0))
    return t.metered.select(
        "channel",
        TS,
        F.coalesce(F.col("energy_kwh") > limit, F.lit(False)).alias("beyond"),
        energy.alias("energy_or_zero"),
        F.when(F.col("meter_kwh") > 2500, "high").otherwise("low").alias("level"),
    )


@register(
    "fn_month_key",
    f"SELECT zone, utc_timestamp, CAST(date_trunc('month', {local('utc_timestamp')}) AS DATE) "
    "AS local_month FROM shipping_hours",
)
def fn_month_key(t):
    return t.shipping_hours.select("zone", TS, cal.month_key(cal.to_market(TS)).alias("local_month"))


@register(
    "fn_parse_time",
    "SELECT event_id, date_trunc('second', ts) AS from_epoch, date_trunc('month', ts) AS from_label, "
    "date_trunc('minute', ts) AS from_iso FROM events",
)
def fn_parse_time(t):
    """Epoch seconds, month labels and ISO text, each written from and read back
    to the event time."""
    ts = F.col("ts")
    return t.given("events").select(
        "event_id",
        cal.from_epoch(cal.epoch_seconds(ts)).alias("from_epoch"),
        cal.from_month_label(F.date_format(ts, "MM.yyyy")).alias("from_label"),
        cal.from_iso(F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).alias("from_iso"),
    )


@register(
    "fn_to_numeric",
    "SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' "
    "ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events",
)
def fn_to_numeric(t):
    typed = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(
        F.col("value").cast("string")
    )
    return t.given("events").select("event_id", numbers.to_number(typed).alias("number"))


@register(
    "fn_channel_parse",
    "SELECT utc_timestamp, channel, nullif(regexp_extract(channel, '^DE_KN_(([a-z]+)\\d*)_(.+)$', 1), '') "
    "AS building, nullif(regexp_extract(channel, '^DE_KN_(([a-z]+)\\d*)_(.+)$', 2), '') "
    "AS building_type, nullif(regexp_extract(channel, '^DE_KN_(([a-z]+)\\d*)_(.+)$', 3), '') "
    "AS device FROM raw_household",
)
def fn_channel_parse(t):
    parts = text.channel_parts("channel")
    return t.raw_household.select(TS, "channel", *[c.alias(n) for n, c in parts.items()])


@register(
    "fn_units",
    "SELECT event_id, value * 1000 AS gw_as_mw, value / 1000 AS kwh_as_mw, value * 1000 AS mw_as_kw, "
    "value / 640 * (10.0 / 1000) AS array_mw FROM events",
    "gw_as_mw kwh_as_mw mw_as_kw array_mw:12",
)
def fn_units(t):
    value = F.col("value")
    return t.given("events").select(
        "event_id",
        numbers.gw_to_mw(value).alias("gw_as_mw"),
        numbers.kwh_to_mw(value).alias("kwh_as_mw"),
        numbers.mw_to_kw(value).alias("mw_as_kw"),
        numbers.array_output_mw(value / 640, F.lit(vocab.SYSTEM_KWP)).alias("array_mw"),
    )


@register(
    "fn_target_day",
    f"SELECT event_id, CAST({local('ts')} AS DATE) + 1 AS target_date, hour({local('ts')}) >= 13 "
    "AS prices_expected FROM events",
)
def fn_target_day(t):
    return t.given("events").select(
        "event_id",
        cal.target_day("ts").alias("target_date"),
        cal.prices_expected("ts").alias("prices_expected"),
    )


@register(
    "fn_hour_spine",
    "SELECT d AS day, (CAST(d AS TIMESTAMP) AT TIME ZONE 'Europe/Berlin' AT TIME ZONE 'UTC') "
    "+ INTERVAL '1' HOUR * CAST(k AS INT) AS utc_timestamp FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d "
    "FROM lineitem) CROSS JOIN range(24) r(k)",
)
def fn_hour_spine(t):
    """24 hours from local midnight for every ship date, clock changes included."""
    days = t.given("lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.select("day", F.explode(cal.hour_spine("day")).alias(TS))


@register(
    "fn_hour_of_week",
    f"SELECT zone, utc_timestamp, (isodow(l) - 1) * 24 + hour(l) AS hour_of_week FROM (SELECT *, "
    f"{local('utc_timestamp')} AS l FROM shipping_hours)",
)
def fn_hour_of_week(t):
    return t.shipping_hours.select("zone", TS, cal.hour_of_week(cal.to_market(TS)).alias("hour_of_week"))


@register(
    "fn_week_bucket",
    f"SELECT zone, utc_timestamp, (dayofyear({local('utc_timestamp')}) - 1) // 7 AS week "
    "FROM shipping_hours",
)
def fn_week_bucket(t):
    day = F.dayofyear(cal.to_market(TS))
    return t.shipping_hours.select("zone", TS, cal.week_bucket(day).alias("week"))


@register(
    "fn_consumption",
    "SELECT utc_timestamp, building, grid_import_kwh + coalesce(pv_kwh, 0) - "
    "coalesce(grid_export_kwh, 0) AS consumption_kwh FROM per_device",
    "consumption_kwh",
)
def fn_consumption(t):
    from noonwatt.plans.staging import device_energy

    demand = numbers.consumption("grid_import_kwh", "pv_kwh", "grid_export_kwh")
    return device_energy(t.stg_household).select(TS, "building", demand.alias("consumption_kwh"))


@register(
    "fn_hour_list",
    f"SELECT zone, day, string_agg(label, ', ' ORDER BY label) AS negative_hours FROM (SELECT "
    f"DISTINCT zone, {DAY} AS day, lpad(CAST(hour({local('utc_timestamp')}) AS VARCHAR), 2, '0') "
    "|| ':00' AS label FROM raw_price WHERE price_eur_mwh < 0) GROUP BY zone, day",
)
def fn_hour_list(t):
    """Hours of each local day with a negative quarter-hour price."""
    hours = F.collect_set(F.hour(cal.to_market(TS)))
    negative = t.raw_price.where(F.col("price_eur_mwh") < 0)
    return negative.groupBy("zone", cal.market_date(TS).alias("day")).agg(
        text.hour_list(hours).alias("negative_hours")
    )


@register(
    "fn_error_terms",
    "SELECT zone, e AS error, abs(e) AS abs_error, e * e AS squared_error FROM (SELECT zone, "
    "predicted_capacity_factor - actual_capacity_factor AS e FROM scored_all)",
    "error abs_error squared_error",
)
def fn_error_terms(t):
    scored = scoring.score_log(t.prediction_log, t.stg_solar, t.stg_tso, latest_only=False)
    error = F.col("predicted_capacity_factor") - F.col("actual_capacity_factor")
    return scored.select(
        "zone",
        error.alias("error"),
        F.abs(error).alias("abs_error"),
        (error * error).alias("squared_error"),
    )


# --- audits ------------------------------------------------------------------------------------


@register(
    "audit_duplicates",
    "SELECT zone, utc_timestamp, count(*) AS occurrences FROM raw_weather GROUP BY zone, "
    "utc_timestamp HAVING count(*) > 1",
)
def audit_duplicates(t):
    """Long-form weather repeats each hour once per location, so it must be caught."""
    return quality.duplicates(t.stg_weather)


@register(
    "audit_unbroken_grid",
    "SELECT * FROM (SELECT zone, utc_timestamp, date_diff('minute', lag(utc_timestamp) OVER "
    "(ORDER BY utc_timestamp), utc_timestamp) AS step_minutes FROM stg_price) "
    "WHERE step_minutes IS NOT NULL AND step_minutes <> 60",
)
def audit_unbroken_grid(t):
    return quality.broken_grid(t.stored("stg_price"))


COUNTED = (
    "SELECT zone, date_trunc('hour', utc_timestamp) AS utc_timestamp, count(*) AS source_intervals "
    "FROM raw_price GROUP BY ALL"
)


@register(
    "audit_partial_hours",
    "SELECT zone, utc_timestamp, source_intervals FROM counted WHERE source_intervals NOT IN (1, 4)",
    counted=COUNTED,
)
def audit_partial_hours(t):
    """On the hours before the completeness rule dropped them."""
    counted = t.raw_price.groupBy("zone", cal.hour_start(TS).alias(TS)).agg(
        F.count(F.lit(1)).alias("source_intervals")
    )
    return quality.partial_hours(counted)


GATE_FROM = (
    f"SELECT p.zone, p.issued_at AS gate_utc, p.utc_timestamp, date_diff('hour', p.issued_at, "
    "p.utc_timestamp) AS horizon_hours FROM prediction_log p"
)


def _issued(t):
    """Saved forecasts, their issue time in the place of the gate."""
    return t.prediction_log.select(
        "zone", F.col("issued_at").alias("gate_utc"), TS,
        cal.hours_between("issued_at", TS).alias("horizon_hours"),
    )


def _hours_stored(t):
    """The hours as a table: an audit's filter would else be pushed below the grouping that
    makes them, and place every raw row on the calendar."""
    return t.stored("shipping_hours")


@register(
    "audit_gate_precedes",
    "SELECT zone, utc_timestamp, gate_utc, horizon_hours FROM late WHERE gate_utc >= utc_timestamp",
    late=f"SELECT zone, utc_timestamp, g AS gate_utc, date_diff('hour', g, utc_timestamp) AS "
    f"horizon_hours FROM (SELECT zone, utc_timestamp, {gate(local('utc_timestamp'))} + INTERVAL 24 HOUR "
    "AS g FROM shipping_hours)",
)
def audit_gate_precedes(t):
    """With the gate a day too late: every hour before local noon must be caught."""
    late = _hours_stored(t).withColumn("gate_utc", cal.gate(cal.to_market(TS)) + cal.hours(24))
    late = late.withColumn("horizon_hours", cal.hours_between("gate_utc", TS))
    return quality.gate_not_before_target(late)


@register(
    "audit_horizon",
    "SELECT zone, utc_timestamp, horizon_hours FROM issued WHERE horizon_hours < 12 OR "
    "horizon_hours > 36 UNION ALL SELECT zone, utc_timestamp, horizon_hours FROM shifted WHERE "
    "horizon_hours < 12 OR horizon_hours > 36",
    issued=GATE_FROM,
    shifted=f"SELECT zone, utc_timestamp, date_diff('hour', {gate(local('utc_timestamp'))}, "
    "utc_timestamp) + 1 AS horizon_hours FROM shipping_hours",
)
def audit_horizon(t):
    """Issue times pass; horizons counted an hour too long fail at the day's end."""
    gated = _hours_stored(t).withColumn("gate_utc", cal.gate(cal.to_market(TS)))
    shifted = gated.withColumn("horizon_hours", cal.hours_between("gate_utc", TS) + 1)
    return quality.horizon_out_of_range(_issued(t)).unionByName(
        quality.horizon_out_of_range(shifted)
    )


@register(
    "audit_cf_physical",
    "SELECT zone, utc_timestamp, x AS solar_capacity_factor FROM (SELECT zone, utc_timestamp, "
    "solar_mw * 20000 / solar_ac_mw AS x FROM stg_solar_daily) WHERE x < 0 OR x > 1",
    "solar_capacity_factor",
)
def audit_cf_physical(t):
    """The daily series in a unit 20,000 times too small."""
    scaled = t.stg_solar_daily.withColumn(
        vocab.TARGET, F.try_divide(F.col("solar_mw") * 20000, F.col("solar_ac_mw"))
    )
    return quality.unphysical_output(scaled)


@register(
    "check_span_agreement",
    "SELECT min(n) AS min_rows, max(n) AS max_rows, max(n) - min(n) AS row_difference, "
    "date_diff('hour', max(first_ts), min(last_ts)) // 24 AS overlap_days FROM cov",
    cov=COVERAGE,
)
def check_span_agreement(t):
    return quality.span_agreement(_hourly_models(t))


@register(
    "check_locations_complete",
    "SELECT zone, utc_timestamp, count(*) AS locations FROM raw_weather GROUP BY zone, utc_timestamp "
    "HAVING count(*) <> 9",
)
def check_locations_complete(t):
    return quality.thin_hours(t.stg_weather)


@register(
    "check_join_loss",
    "SELECT (SELECT count(*) FROM mart) AS mart_rows, (SELECT count(*) FROM stg_weather_national) "
    "AS weather_rows, (SELECT count(*) FROM mart) >= (SELECT count(*) FROM stg_weather_national) - 48 "
    "AS covered, (SELECT count(*) FROM stg_generation g LEFT JOIN stg_weather_national w USING "
    "(utc_timestamp) WHERE w.utc_timestamp IS NULL AND g.utc_timestamp BETWEEN (SELECT "
    "min(utc_timestamp) FROM stg_weather_national) AND (SELECT max(utc_timestamp) FROM "
    "stg_weather_national)) AS unmatched",
)
def check_join_loss(t):
    weather = t.stored("stg_weather_national")
    lost = quality.uncovered_hours(t.stored("stg_generation"), weather)
    return quality.join_loss(t.mart, weather, lost)


HORIZONS = (
    "SELECT zone, horizon_hours, count(*) AS n, count(*) FILTER (m = 10) AS in_october FROM (SELECT "
    f"zone, month({local('utc_timestamp')}) AS m, date_diff('hour', {gate(local('utc_timestamp'))}, "
    "utc_timestamp) AS horizon_hours FROM shipping_hours) GROUP BY zone, horizon_hours"
)


@register("check_horizon_hist", HORIZONS)
def check_horizon_hist(t):
    """Seven years of hours: 36 occurs only on the 25-hour day in October."""
    placed = t.shipping_hours.withColumn("local_datetime", cal.to_market(TS))
    gated = placed.withColumn(
        "horizon_hours", cal.hours_between(cal.gate("local_datetime"), F.col(TS))
    )
    return explore.horizon_histogram(gated)


@register(
    "check_lag_correct",
    "SELECT a.zone, a.utc_timestamp, a.capacity_factor_lag_48h, b.solar_capacity_factor AS actual "
    "FROM mart a JOIN mart b ON b.utc_timestamp = a.utc_timestamp - INTERVAL 48 HOUR "
    "WHERE abs(a.capacity_factor_lag_48h - b.solar_capacity_factor) > 1e-9",
    "capacity_factor_lag_48h actual",
)
def check_lag_correct(t):
    """On a grid with holes positional lags are not temporal ones; those rows show."""
    return quality.lag_mismatches(t.stored("mart"), "capacity_factor_lag_48h", vocab.TARGET, 48)


@register(
    "check_cf_bounds",
    "SELECT zone, min(solar_capacity_factor) AS lo, max(solar_capacity_factor) AS hi, "
    "count(*) FILTER (solar_capacity_factor IS NULL) AS missing FROM mart GROUP BY zone",
    "lo hi",
)
def check_cf_bounds(t):
    return explore.bounds(t.mart)


@register(
    "check_trend_removed",
    "SELECT zone, max_by(capacity_gw, year) / min_by(capacity_gw, year) - 1 AS capacity_growth, "
    "max(capacity_factor) / min(capacity_factor) - 1 AS capacity_factor_drift FROM by_year "
    "GROUP BY zone",
    "capacity_growth:8 capacity_factor_drift:8",
    by_year=YEARLY,
)
def check_trend_removed(t):
    return explore.trend_removed(t.stg_solar_daily)


@register(
    "check_spread",
    "SELECT zone, avg(ghi_spread) AS mean_spread, max(ghi_spread) AS max_spread FROM mart "
    "WHERE ghi_max > 100 GROUP BY zone",
    "mean_spread max_spread",
)
def check_spread(t):
    return explore.regional_spread(t.mart)


@register(
    "check_intervals_mix",
    "SELECT zone, source_intervals, count(*) AS n FROM stg_price GROUP BY ALL",
)
def check_intervals_mix(t):
    return explore.interval_mix(t.stg_price)


@register(
    "check_schema",
    "SELECT building || '_' || device AS channel_name FROM (SELECT DISTINCT building FROM "
    "raw_household) CROSS JOIN (VALUES ('grid_import'), ('grid_export'), ('pv'), ('heat_pump'), "
    "('ev'), ('dishwasher')) d(device) EXCEPT SELECT building || '_' || device FROM raw_household",
)
def check_schema(t):
    """Expected device channels no building delivers."""
    devices = [*vocab.DEVICE_COLUMNS, "dishwasher"]
    wanted = t.raw_household.select("building").distinct().select(
        F.explode(
            F.array(*[F.concat("building", F.lit("_" + d)) for d in devices])
        ).alias("channel_name")
    )
    found = t.raw_household.select(F.concat("building", F.lit("_"), "device").alias("channel_name"))
    return wanted.join(found.distinct(), "channel_name", "left_anti")


@register(
    "check_ac_below_dc",
    "SELECT zone, month, solar_ac_mw, solar_dc_mw, solar_ac_mw > 0 AND solar_ac_mw < solar_dc_mw "
    "AS ac_below_dc FROM stg_capacity WHERE solar_ac_mw IS NOT NULL AND solar_dc_mw IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY zone ORDER BY month DESC) = 1",
)
def check_ac_below_dc(t):
    below = (F.col("solar_ac_mw") > 0) & (F.col("solar_ac_mw") < F.col("solar_dc_mw"))
    return explore.latest_capacity(t.stg_capacity).withColumn("ac_below_dc", below)


@register(
    "check_weather_era",
    "SELECT zone, count(*) AS n, year(min(utc_timestamp)) AS first_year, date_diff('hour', "
    "min(utc_timestamp), max(utc_timestamp)) // 24 AS span_days FROM stg_weather_national "
    "GROUP BY zone",
)
def check_weather_era(t):
    return explore.series_era(t.stg_weather_national)
