"""Battery schedules and day plans.

The best value of a day is unique, and with prices that differ so is the schedule: SQL
finds both by dynamic programming.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.operators import profile
from noonwatt.plans import dayplan, dispatch
from workload import dispatch_sql
from workload.adapters import batteries, sites
from workload.ctes import local, utc
from workload.explore_queries import PROFILE_CTES
from workload.registry import register

TS = "utc_timestamp"
DAILY = "energy_mwh revenue_eur:7 planned_revenue_eur:7 energy_cycled_mwh:7 price_spread_eur_mwh:6"


def _fleet(t):
    """Every battery size in every zone with prices."""
    every = batteries(t.spark)
    zones = F.explode(F.array(*[F.lit(z) for z in t.zones])).alias("zone")
    owners = sites(t.spark, t.sf_dir).select("battery_id").distinct().select("battery_id", zones)
    return owners.join(every, "battery_id")


@register(
    "dispatch_days",
    "SELECT zone, day, battery_id, utc_timestamp, actual AS price_eur_mwh, charge_mw, discharge_mw, "
    "state_of_charge_mwh FROM dp_schedule",
    "price_eur_mwh charge_mw:8 discharge_mw:8 state_of_charge_mwh:8",
    **dispatch_sql.PERFECT,
)
def dispatch_days(t):
    days = dispatch.price_days(t.price_hourly)
    return dispatch.schedule_hours(dispatch.dispatch(days, _fleet(t)))


@register("dispatch_perfect", "SELECT * FROM dp_daily", DAILY, **dispatch_sql.PERFECT)
def dispatch_perfect(t):
    return dispatch.perfect_foresight(t.price_hourly, _fleet(t))


@register("dispatch_naive", "SELECT * FROM nv_daily", DAILY, **dispatch_sql.NAIVE)
def dispatch_naive(t):
    return dispatch.previous_day_prices(t.price_hourly, _fleet(t))


@register(
    "dispatch_summary",
    dispatch_sql.SUMMARY,
    "total_eur:7 mean_daily_eur:7 annual_eur:5 cycles_per_day:6 cycles_per_year:4 capture_rate:6 forecast_value_eur:5",
    **dispatch_sql.SUMMARY_CTES,
)
def dispatch_summary(t):
    prices, fleet = t.stored("price_hourly"), _fleet(t)
    return dispatch.strategy_summary(
        dispatch.perfect_foresight(prices, fleet), dispatch.previous_day_prices(prices, fleet)
    )


# --- day plans ------------------------------------------------------------------------------

PLAN_CTES = {
    **PROFILE_CTES,
    "pl_prices": "SELECT zone, utc_timestamp, round(price_eur_mwh, 6) AS price_eur_mwh FROM price_hourly",
    "pl_priced": "SELECT * FROM (SELECT p.zone, p.utc_timestamp, p.target_date, "
    "p.predicted_capacity_factor, q.price_eur_mwh, count(*) OVER (PARTITION BY p.zone, p.target_date) "
    "AS priced_hours FROM latest_issue p JOIN pl_prices q USING (utc_timestamp)) WHERE priced_hours >= 24",
    "pl_sites": "SELECT s_suppkey AS site_id, 'DE' AS zone, 4.0 + s_nationkey * 0.5 AS system_kwp, "
    "'B' || CAST(s_nationkey % 5 AS VARCHAR) AS battery_id, "
    "'residential' || CAST(s_suppkey % 11 AS VARCHAR) AS building FROM supplier",
    "pl_days": "SELECT DISTINCT target_date AS day FROM latest_issue",
    "pl_load": f"SELECT l.building, d.day, {utc('CAST(d.day AS TIMESTAMP)')} + INTERVAL '1' HOUR * "
    "CAST(r.k AS INT) AS utc_timestamp, l.overall FROM prof_level l CROSS JOIN pl_days d "
    "CROSS JOIN range(24) r(k)",
    "pl_profile": "SELECT h.building, h.utc_timestamp, coalesce(c.mean_kwh, h.overall) AS load_kwh FROM "
    "pl_load h LEFT JOIN prof_cells c ON c.building = h.building AND c.hw = "
    f"(isodow({local('h.utc_timestamp')}) - 1) * 24 + hour({local('h.utc_timestamp')})",
    "pl_hours": "SELECT s.site_id, s.zone, s.building, p.target_date, p.utc_timestamp, p.price_eur_mwh, "
    "p.predicted_capacity_factor * (s.system_kwp / 1000) AS solar_mw, coalesce(f.load_kwh / 1000, 0.0004) "
    "AS load_mw FROM pl_sites s JOIN pl_priced p ON s.zone = p.zone LEFT JOIN pl_profile f ON "
    "f.building = s.building AND f.utc_timestamp = p.utc_timestamp",
}


PLANNED_SQL = (
    "SELECT zone, target_date AS day, utc_timestamp, price_eur_mwh AS actual, price_eur_mwh AS planning FROM pl_priced"
)


def _prices(t):
    return t.stored("price_hourly").withColumn("price_eur_mwh", F.round("price_eur_mwh", 6))


def _prediction(t):
    return t.stored("latest_prediction")


def _load(t, without: str | None = None):
    """Profiles of all buildings; the sites of one ``without`` a profile draw a flat load."""
    load = t.stored("mart_household")
    if without:
        load = load.where(F.col("building") != without)
    buildings = t.stored("sites").select("zone", "building").distinct()
    zoned = _prediction(t).select("zone", F.col("target_date").alias("day")).distinct()
    wanted = buildings.join(zoned, "zone").select("building", "day").distinct()
    return profile.profile_for_days(profile.fit_profiles(load), wanted)


def _site_days(t, without: str | None = None):
    priced = dayplan.priced_hours(_prediction(t), _prices(t), strict=False)
    return dayplan.site_days(priced, t.stored("sites"), _load(t, without))


def _plan(t):
    return dayplan.planned_days(
        _prediction(t), _prices(t), t.stored("sites"), batteries(t.spark), _load(t), strict=False
    )


@register(
    "join_priced_hours",
    "SELECT zone, utc_timestamp, target_date, predicted_capacity_factor, price_eur_mwh, priced_hours "
    "FROM pl_priced",
    "predicted_capacity_factor",
    **PLAN_CTES,
)
def join_priced_hours(t):
    priced = dayplan.priced_hours(_prediction(t), _prices(t), strict=False)
    return priced.select(
        "zone", TS, "target_date", "predicted_capacity_factor", "price_eur_mwh", "priced_hours"
    )


@register(
    "load_fallback",
    "SELECT zone, site_id, target_date, utc_timestamp, load_mw FROM pl_hours",
    "load_mw",
    **{
        **PLAN_CTES,
        "pl_profile": PLAN_CTES["pl_profile"] + " WHERE h.building <> 'residential0'",
    },
)
def load_fallback(t):
    """One building has no profile here, so its sites fall back to the flat draw."""
    hours = _site_days(t, without="residential0").select(
        "zone", "site_id", F.col("day").alias("target_date"), F.explode(F.arrays_zip("hours", "load_mw")).alias("h")
    )
    return hours.select("zone", "site_id", "target_date", F.col(f"h.hours.{TS}").alias(TS), "h.load_mw")


@register(
    "solar_value",
    "SELECT zone, site_id, target_date, sum(price_eur_mwh * least(solar_mw, load_mw)) AS solar_value_eur "
    "FROM pl_hours GROUP BY zone, site_id, target_date",
    "solar_value_eur:6",
    **PLAN_CTES,
)
def solar_value(t):
    return dayplan.solar_values(_site_days(t))


@register(
    "plan_day",
    "SELECT s.zone, s.site_id, h.target_date, any_value(d.revenue_eur) AS revenue_eur, "
    "sum(h.price_eur_mwh * least(h.solar_mw, h.load_mw)) AS solar_value_eur, any_value(d.revenue_eur) + "
    "sum(h.price_eur_mwh * least(h.solar_mw, h.load_mw)) AS total_benefit_eur, "
    "sum(round(h.solar_mw * 1000, 6)) AS predicted_generation_kwh, "
    "sum(round(h.load_mw * 1000, 6)) AS expected_consumption_kwh FROM pl_hours h JOIN pl_sites s USING (site_id) "
    "JOIN pn_daily d ON d.day = h.target_date AND d.battery_id = s.battery_id GROUP BY s.zone, s.site_id, h.target_date",
    "revenue_eur:7 solar_value_eur:7 total_benefit_eur:7 predicted_generation_kwh:6 expected_consumption_kwh:6",
    **PLAN_CTES,
    **dispatch_sql.schedule(PLANNED_SQL, "pn"),
)
def plan_day(t):
    return dayplan.plan_days(_plan(t))


HOUR_OF = f"hour({local('utc_timestamp')})"


def _best(order: str) -> str:
    return (
        "SELECT zone, site_id, target_date, string_agg(DISTINCT lpad(CAST(h AS VARCHAR), 2, '0') || ':00', "
        "', ' ORDER BY lpad(CAST(h AS VARCHAR), 2, '0') || ':00') AS hours FROM (SELECT zone, site_id, "
        f"target_date, {HOUR_OF} AS h, row_number() OVER (PARTITION BY zone, site_id, target_date ORDER BY "
        f"{order}, utc_timestamp) AS k FROM pl_hours) WHERE k <= 3 GROUP BY zone, site_id, target_date"
    )


ADVICE_HOURS = (
    "SELECT c.zone, c.site_id, c.target_date, c.hours AS cheapest_hours, d.hours AS dearest_hours, "
    "p.h AS solar_peak_hour, p.kw AS solar_peak_kw FROM pl_cheap c JOIN pl_dear d USING "
    "(zone, site_id, target_date) JOIN pl_peak p USING (zone, site_id, target_date)"
)
ADVICE_CTES = {
    "pl_cheap": _best("price_eur_mwh"),
    "pl_dear": _best("price_eur_mwh DESC"),
    "pl_peak": "SELECT * FROM (SELECT zone, site_id, target_date, "
    f"{HOUR_OF} AS h, round(solar_mw * 1000, 6) AS kw, row_number() OVER (PARTITION BY zone, site_id, "
    "target_date ORDER BY round(solar_mw * 1000, 6) DESC, utc_timestamp) AS k FROM pl_hours) WHERE k = 1",
    **PLAN_CTES,
}


@register("plan_advice_hours", ADVICE_HOURS, "solar_peak_kw:6", **ADVICE_CTES)
def plan_advice_hours(t):
    """The part of the advice that does not depend on the schedule."""
    return dayplan.hour_advice(dayplan.in_kw(_site_days(t)))


def _running(what: str) -> str:
    return (
        "SELECT zone, day, battery_id, string_agg(DISTINCT lpad(CAST(h AS VARCHAR), 2, '0') || ':00', ', ' ORDER BY "
        f"lpad(CAST(h AS VARCHAR), 2, '0') || ':00') AS hours FROM (SELECT *, {HOUR_OF} AS h FROM pn_schedule) "
        f"WHERE round({what}_mw * 1000, 6) > 0.01 GROUP BY zone, day, battery_id"
    )


def _figure(value: str, digits: int) -> str:
    """As Java prints it: half away from zero, and a minus before a negative zero."""
    shown = f"CAST(CAST(CAST({value} AS DECIMAL(24, 9)) AS DECIMAL(24, {digits})) AS VARCHAR)"
    return f"CASE WHEN {value} < 0 AND left({shown}, 1) <> '-' THEN '-' ELSE '' END || {shown}"


def _said(name: str, *values: str) -> str:
    """A sentence of the advice with its marks filled in."""
    parts = re.split(r"%s|%02d|%\.\d+f", vocab.ADVICE[name])
    assert len(parts) == len(values) + 1
    told = [f"'{parts[0]}'"] + [x for v, p in zip(values, parts[1:]) for x in (v, f"'{p}'")]
    return " || ".join(told)


@register(
    "plan_advice",
    "SELECT * EXCLUDE (solar_eur, revenue_eur), concat_ws(chr(10), "
    + _said("prices", "cheapest_hours", "dearest_hours") + ", "
    + f"CASE WHEN charge_hours <> '' THEN {_said('charge', 'charge_hours')} END, "
    + f"CASE WHEN discharge_hours <> '' THEN {_said('discharge', 'discharge_hours')} END, "
    + _said("solar", "lpad(CAST(solar_peak_hour AS VARCHAR), 2, '0')", _figure("solar_peak_kw", 1)) + ", "
    + _said("benefit", "strftime(target_date, '%Y-%m-%d')", _figure("total_benefit_eur", 2), _figure("revenue_eur", 2),
            _figure("solar_eur", 2))
    + ") AS advice FROM (SELECT a.zone, a.site_id, a.target_date, cheapest_hours, dearest_hours, "
    "coalesce(c.hours, '') AS charge_hours, coalesce(d.hours, '') AS discharge_hours, solar_peak_hour, solar_peak_kw, "
    "revenue_eur, solar_eur, revenue_eur + solar_eur AS total_benefit_eur FROM pl_advice a JOIN pl_sites s USING (site_id) "
    "JOIN pl_worth w USING (site_id, target_date) JOIN pn_daily p ON p.day = a.target_date AND p.battery_id = s.battery_id "
    "LEFT JOIN pn_charge c ON c.day = a.target_date AND c.battery_id = s.battery_id "
    "LEFT JOIN pn_discharge d ON d.day = a.target_date AND d.battery_id = s.battery_id)",
    "total_benefit_eur:7 solar_peak_kw:6",
    pl_advice=ADVICE_HOURS,
    pl_worth="SELECT site_id, target_date, sum(price_eur_mwh * least(solar_mw, load_mw)) AS solar_eur FROM pl_hours "
    "GROUP BY site_id, target_date",
    pn_charge=_running("charge"),
    pn_discharge=_running("discharge"),
    **ADVICE_CTES,
    **dispatch_sql.schedule(PLANNED_SQL, "pn"),
)
def plan_advice(t):
    return dayplan.advice(_plan(t)).withColumn("advice", F.array_join("advice", "\n"))


@register(
    "day_totals",
    "SELECT zone, site_id, target_date, sum(round(solar_mw * 1000, 6)) AS predicted_generation_kwh, "
    "sum(round(load_mw * 1000, 6)) AS expected_consumption_kwh, count(*) AS priced_hours FROM pl_hours "
    "GROUP BY zone, site_id, target_date",
    "predicted_generation_kwh:6 expected_consumption_kwh:6",
    **PLAN_CTES,
)
def day_totals(t):
    return dayplan.day_totals(dayplan.in_kw(_site_days(t)))
