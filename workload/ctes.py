"""SQL for DuckDB: the same raw tables and models as named, reusable queries."""

from __future__ import annotations

import re

from noonwatt import vocab

TZ = vocab.MARKET_TZ


def local(ts: str) -> str:
    return f"({ts} AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}')"


def utc(local_ts: str) -> str:
    return f"({local_ts} AT TIME ZONE '{TZ}' AT TIME ZONE 'UTC')"


def gate(local_ts: str) -> str:
    return utc(f"(CAST(CAST({local_ts} AS DATE) AS TIMESTAMP) - INTERVAL 12 HOUR)")


SERIES_CASE = (
    "CASE event_type WHEN 'signup' THEN 'Solar' WHEN 'click' THEN 'Wind onshore' "
    "WHEN 'view' THEN 'Wind offshore' WHEN 'purchase' THEN 'Load' ELSE 'Residual load' END"
)
LOCATION_CASE = (
    "CASE user_id % 9 "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(vocab.LOCATIONS))
    + " END"
)


def point_case(i: int) -> str:
    return "CASE location " + " ".join(
        f"WHEN '{n}' THEN CAST({p[i]} AS DOUBLE)" for n, p in vocab.LOCATIONS.items()
    ) + " END"


HOUR = "date_trunc('hour', ts)"


def pivot(agg: str, category: str, value: str, columns: dict[str, str]) -> str:
    return ", ".join(
        f"{agg}(CASE WHEN {category} = '{k}' THEN {value} END) AS {v}" for k, v in columns.items()
    )


def calendar(ts: str) -> str:
    h, d = f"hour({ts})", f"dayofyear({ts})"
    return (
        f"{h} AS hour_of_day, dayofweek({ts}) + 1 AS day_of_week, {d} AS day_of_year, "
        f"month({ts}) AS month_of_year, sin(2 * pi() * {h} / 24) AS hour_sin, "
        f"cos(2 * pi() * {h} / 24) AS hour_cos, sin(2 * pi() * {d} / 365.25) AS day_of_year_sin, "
        f"cos(2 * pi() * {d} / 365.25) AS day_of_year_cos"
    )


def national(ghi: str, direct: str, diffuse: str, temp: str, cloud: str) -> str:
    return (
        f"avg({ghi}) AS ghi_mean, min({ghi}) AS ghi_min, max({ghi}) AS ghi_max, "
        f"stddev_pop({ghi}) AS ghi_stddev, max({ghi}) - min({ghi}) AS ghi_spread, "
        f"avg({direct}) AS direct_radiation_mean, avg({diffuse}) AS diffuse_radiation_mean, "
        f"avg({temp}) AS temperature_mean, avg({cloud}) AS cloud_cover_mean, "
        f"stddev_pop({cloud}) AS cloud_cover_stddev"
    )


LOCATION_NAMES = {n: f"ghi_{n}" for n in vocab.LOCATIONS}
WEATHER_DAY_AHEAD = (
    "ghi_wm2_day_ahead", "direct_radiation_wm2_day_ahead", "diffuse_radiation_wm2_day_ahead",
    "temperature_c_day_ahead", "cloud_cover_pct_day_ahead",
)


def solar_from(gen: str, cap: str) -> str:
    return f"""
 SELECT zone, utc_timestamp, local_datetime, solar_mw, solar_ac_mw,
   CASE WHEN solar_ac_mw = 0 THEN NULL ELSE solar_mw / solar_ac_mw END AS solar_capacity_factor,
   reported IS NULL AS capacity_carried_forward
 FROM (SELECT *, last_value(reported IGNORE NULLS) OVER (ORDER BY utc_timestamp
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS solar_ac_mw
       FROM (SELECT g.zone, g.utc_timestamp, {local('g.utc_timestamp')} AS local_datetime,
                    g.solar_mw, c.capacity_mw AS reported
             FROM {gen} g LEFT JOIN {cap} c
             ON date_trunc('month', {local('g.utc_timestamp')}) = c.month))"""


CTES: dict[str, str] = {
    "raw_price": f"""
 SELECT 'DE' AS zone, {HOUR} + INTERVAL '15' MINUTE * CAST(floor(minute(ts) / 15) AS INT)
   AS utc_timestamp, max_by(value, event_id) - 20 AS price_eur_mwh FROM events GROUP BY ALL""",
    "raw_public_power": f"""
 SELECT 'DE' AS zone, {HOUR} AS utc_timestamp, {SERIES_CASE} AS production_type,
   max_by(value, event_id) AS power_mw FROM events GROUP BY ALL""",
    "raw_day_ahead_forecast": f"""
 SELECT 'DE' AS zone, {HOUR} AS utc_timestamp,
   lower(replace({SERIES_CASE}, ' ', '_')) AS production_type, max(value) AS forecast_mw
 FROM events WHERE event_type <> 'error' GROUP BY ALL""",
    "raw_weather": f"""
 SELECT 'DE' AS zone, utc_timestamp, location, {point_case(0)} AS latitude,
   {point_case(1)} AS longitude, v / 16 - 5 AS temperature_c_day_ahead,
   CASE WHEN v < 5 THEN 0.0 ELSE v END AS ghi_wm2_day_ahead,
   v * 0.5 AS direct_radiation_wm2_day_ahead, v * 0.25 AS diffuse_radiation_wm2_day_ahead,
   v / 8 AS cloud_cover_pct_day_ahead, m / 16 - 5 AS temperature_c, m AS ghi_wm2,
   m * 0.5 AS direct_radiation_wm2, m * 0.25 AS diffuse_radiation_wm2, m / 8 AS cloud_cover_pct
 FROM (SELECT {HOUR} AS utc_timestamp, {LOCATION_CASE} AS location,
         max_by(value, event_id) AS v, max(value) AS m FROM events GROUP BY ALL)""",
    "raw_household": f"""
 SELECT utc_timestamp, 'DE_KN_' || building || '_' || device AS channel, building,
   'residential' AS building_type, device, CAST(sum(v) OVER (PARTITION BY building, device
     ORDER BY utc_timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 5000 AS DOUBLE)
   AS meter_kwh
 FROM (SELECT {HOUR} AS utc_timestamp, 'residential' || CAST(user_id % 11 AS VARCHAR) AS building,
         CASE event_type WHEN 'signup' THEN 'grid_import' WHEN 'click' THEN 'grid_export'
           WHEN 'view' THEN 'pv' WHEN 'purchase' THEN 'heat_pump' ELSE 'ev' END AS device,
         sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY ALL)""",
    "daily_generation": """
 SELECT 'DE' AS zone, l_shipdate AS utc_timestamp,
   CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS solar_mw
 FROM lineitem GROUP BY ALL""",
    "raw_installed_power": """
 SELECT 'DE' AS zone, date_trunc('month', o_orderdate) AS month, 'Solar AC' AS production_type,
   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS capacity_mw
 FROM orders WHERE month(o_orderdate) NOT IN (5, 10) GROUP BY ALL""",
    "raw_capacity_types": """
 SELECT 'DE' AS zone, date_trunc('month', o_orderdate) AS month,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'Solar AC' WHEN '2-HIGH' THEN 'Solar DC'
     WHEN '3-MEDIUM' THEN 'Wind onshore' WHEN '4-NOT SPECIFIED' THEN 'Wind offshore'
     ELSE CASE WHEN o_orderstatus = 'F' THEN 'Battery storage (capacity)' ELSE 'Battery storage (power)' END
     END AS production_type,
   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS capacity_mw
 FROM orders GROUP BY ALL""",
    "raw_event_capacity": """
 SELECT 'DE' AS zone, date_trunc('month', ts) AS month, max(value) * 1.25 AS capacity_mw
 FROM events GROUP BY ALL""",
    "prediction_log": f"""
 SELECT 'DE' AS zone, utc_timestamp, {local('utc_timestamp')} AS local_datetime,
   mw / 700 AS predicted_capacity_factor, mw AS predicted_mw,
   CASE WHEN v < 5 THEN 0.0 ELSE v END AS ghi_mean_forecast,
   utc_timestamp - INTERVAL '1' HOUR * ahead AS issued_at,
   CAST({local('utc_timestamp')} AS DATE) AS target_date, model_name
 FROM (SELECT utc_timestamp, hi AS mw, v, 24 AS ahead, 'ridge' AS model_name FROM solar_issues
       UNION ALL
       SELECT utc_timestamp, lo, v, 12, 'gradient_boosting' FROM solar_issues)""",
    "solar_issues": f"""
 SELECT {HOUR} AS utc_timestamp, max(value) AS hi, min(value) AS lo,
   max_by(value, event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY ALL""",
    "shipping_hours": """
 SELECT 'DE' AS zone, l_shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT)
   AS utc_timestamp, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS mw
 FROM lineitem GROUP BY ALL""",
    "stg_price": """
 SELECT zone, date_trunc('hour', utc_timestamp) AS utc_timestamp,
   avg(price_eur_mwh) AS price_eur_mwh, count(*) AS source_intervals
 FROM raw_price WHERE price_eur_mwh IS NOT NULL
 GROUP BY zone, date_trunc('hour', utc_timestamp) HAVING count(*) IN (1, 4)""",
    "price_hourly": """
 SELECT zone, date_trunc('hour', utc_timestamp) AS utc_timestamp,
   avg(price_eur_mwh) AS price_eur_mwh
 FROM raw_price WHERE price_eur_mwh IS NOT NULL
 GROUP BY zone, date_trunc('hour', utc_timestamp)""",
    "stg_generation": f"""
 SELECT zone, date_trunc('hour', utc_timestamp) AS utc_timestamp,
   {pivot('avg', 'production_type', 'power_mw', vocab.GENERATION_COLUMNS)},
   count(*) FILTER (production_type = 'Solar') AS source_intervals
 FROM raw_public_power GROUP BY zone, date_trunc('hour', utc_timestamp)
 HAVING count(*) FILTER (production_type = 'Solar') IN (1, 4)""",
    "stg_tso": f"""
 SELECT zone, date_trunc('hour', utc_timestamp) AS utc_timestamp,
   {pivot('avg', 'production_type', 'forecast_mw', vocab.OPERATOR_FORECAST_COLUMNS)},
   count(*) FILTER (production_type = 'solar') AS source_intervals
 FROM raw_day_ahead_forecast GROUP BY zone, date_trunc('hour', utc_timestamp)
 HAVING count(*) FILTER (production_type = 'solar') IN (1, 4)""",
    "stg_capacity": f"""
 SELECT zone, month, {pivot('max', 'production_type', 'capacity_mw', vocab.CAPACITY_COLUMNS)}
 FROM raw_capacity_types GROUP BY zone, month""",
    "stg_solar_daily": solar_from("daily_generation", "raw_installed_power"),
    "stg_solar": solar_from("stg_generation", "raw_event_capacity"),
    "stg_weather_national": f"""
 SELECT zone, utc_timestamp, {pivot('max', 'location', 'ghi_wm2_day_ahead', LOCATION_NAMES)},
   {national(*WEATHER_DAY_AHEAD)}, count(ghi_wm2_day_ahead) AS locations_reporting
 FROM raw_weather GROUP BY zone, utc_timestamp""",
    "mart": f"""
 SELECT zone, utc_timestamp, local_datetime, gate_utc,
   date_diff('hour', gate_utc, utc_timestamp) AS horizon_hours, solar_mw, solar_ac_mw, cf
     AS solar_capacity_factor, {calendar('local_datetime')},
   {', '.join(vocab.WEATHER_FEATURES)},
   lag(cf, 48) OVER w AS capacity_factor_lag_48h, lag(cf, 72) OVER w AS capacity_factor_lag_72h,
   lag(cf, 168) OVER w AS capacity_factor_lag_168h,
   avg(cf) OVER (ORDER BY utc_timestamp ROWS BETWEEN 215 PRECEDING AND 48 PRECEDING)
     AS capacity_factor_mean_7d,
   avg(cf) OVER (ORDER BY utc_timestamp ROWS BETWEEN 767 PRECEDING AND 48 PRECEDING)
     AS capacity_factor_mean_30d,
   tso_solar_forecast_mw,
   tso_solar_forecast_mw / solar_ac_mw AS tso_solar_forecast_capacity_factor
 FROM (SELECT s.zone, s.utc_timestamp, s.local_datetime, {gate('s.local_datetime')} AS gate_utc,
         s.solar_mw, s.solar_ac_mw, s.solar_capacity_factor AS cf,
         {', '.join('w.' + c for c in vocab.WEATHER_FEATURES)},
         f.solar_forecast_mw AS tso_solar_forecast_mw
       FROM stg_solar s JOIN stg_weather_national w USING (utc_timestamp)
       LEFT JOIN stg_tso f USING (utc_timestamp))
 WINDOW w AS (ORDER BY utc_timestamp)""",
    "frame": "\n SELECT * FROM mart WHERE solar_capacity_factor IS NOT NULL AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in vocab.FEATURES),
    "readings": """
 SELECT *, lag(meter_kwh) OVER w AS previous_kwh, lag(utc_timestamp) OVER w AS previous_timestamp
 FROM raw_household WINDOW w AS (PARTITION BY channel ORDER BY utc_timestamp)""",
    "differenced": """
 SELECT * EXCLUDE (previous_kwh, previous_timestamp),
   CASE WHEN date_diff('minute', previous_timestamp, utc_timestamp) = 60
     AND meter_kwh >= previous_kwh THEN meter_kwh - previous_kwh END AS energy_kwh
 FROM readings""",
    "channel_scale": """
 SELECT channel, quantile_cont(energy_kwh, 0.99) AS p99_kwh
 FROM differenced WHERE energy_kwh IS NOT NULL GROUP BY channel""",
    "stg_household": """
 SELECT d.*, coalesce(d.energy_kwh > greatest(50 * s.p99_kwh, 1.0), FALSE) AS is_implausible
 FROM differenced d LEFT JOIN channel_scale s USING (channel)""",
    "per_device": f"""
 SELECT utc_timestamp, building, building_type,
   {pivot('max', 'device', 'energy_kwh', vocab.DEVICE_COLUMNS)}
 FROM stg_household WHERE NOT is_implausible GROUP BY utc_timestamp, building, building_type""",
    "stg_household_load": f"""
 SELECT utc_timestamp, {local('utc_timestamp')} AS local_datetime, building, building_type,
   {', '.join(vocab.DEVICE_COLUMNS.values())},
   grid_import_kwh + coalesce(pv_kwh, 0) - coalesce(grid_export_kwh, 0) AS consumption_kwh,
   pv_kwh IS NOT NULL AS has_pv
 FROM per_device WHERE grid_import_kwh IS NOT NULL""",
    "mart_household": f"""
 SELECT utc_timestamp, local_datetime, building, building_type, has_pv, consumption_kwh,
   grid_import_kwh, pv_kwh, heat_pump_kwh, ev_kwh, {calendar('local_datetime')},
   dayofweek(local_datetime) IN (0, 6) AS is_weekend,
   lag(consumption_kwh, 48) OVER w AS consumption_lag_48h,
   lag(consumption_kwh, 168) OVER w AS consumption_lag_168h,
   avg(consumption_kwh) OVER (PARTITION BY building ORDER BY utc_timestamp
     ROWS BETWEEN 215 PRECEDING AND 48 PRECEDING) AS consumption_mean_7d
 FROM stg_household_load WHERE consumption_kwh >= 0
 WINDOW w AS (PARTITION BY building ORDER BY utc_timestamp)""",
    "latest_issue": """
 SELECT * FROM prediction_log
 QUALIFY row_number() OVER (PARTITION BY utc_timestamp ORDER BY issued_at DESC) = 1""",
    "scored_all": """
 SELECT p.zone, p.utc_timestamp, p.target_date, p.issued_at, p.model_name,
   p.predicted_capacity_factor, p.ghi_mean_forecast,
   s.solar_capacity_factor AS actual_capacity_factor,
   CASE WHEN s.solar_ac_mw = 0 THEN NULL ELSE f.solar_forecast_mw / s.solar_ac_mw END
     AS tso_capacity_factor
 FROM prediction_log p JOIN stg_solar s USING (utc_timestamp) LEFT JOIN stg_tso f USING (utc_timestamp)
 WHERE s.solar_capacity_factor IS NOT NULL""",
    "scored": """
 SELECT * FROM scored_all
 QUALIFY row_number() OVER (PARTITION BY utc_timestamp ORDER BY issued_at DESC) = 1""",
}

_NAME = re.compile(r"\b[a-z_]+\b")


def _needed(text: str, found: dict[str, None], extra: dict[str, str]) -> None:
    for word in _NAME.findall(text):
        source = extra.get(word, CTES.get(word))
        if source is not None and word not in found:
            _needed(source, found, extra)
            found[word] = None


def sql(body: str, **extra: str) -> str:
    """``body`` with the named queries it refers to, each defined once."""
    found: dict[str, None] = {}
    _needed(body, found, extra)
    if not found:
        return body
    parts = ",\n".join(f"{n} AS ({extra.get(n, CTES.get(n))})" for n in found)
    return f"WITH {parts}\n{body}"
