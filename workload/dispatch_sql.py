"""Battery schedules in SQL: the best path over charge levels, hour by hour.

A level is a share of the battery's energy. Levels worth visiting lie a whole number of
full-power hours away from empty, half or full. ``dp_x`` holds, for each level after hour x,
the best value of a way there and the level it came from; ``bk_x`` walks back from half
charge at the end of the day.
"""

from __future__ import annotations

from string import ascii_lowercase

from workload.ctes import local

HOURS = ascii_lowercase[:24]

FLEET = {
    "dp_battery": "SELECT battery_id, energy, power, rt, sqrt(rt) AS eta, sqrt(rt) * power / energy AS gain, "
    "power / energy / sqrt(rt) AS loss FROM (VALUES ('B0', 0.010::DOUBLE, 0.005::DOUBLE, 0.90::DOUBLE), "
    "('B1', 0.010, 0.003, 0.80), ('B2', 0.020, 0.007, 0.95), ('B3', 0.005, 0.005, 0.90), "
    "('B4', 0.010, 0.005, 1.00)) v(battery_id, energy, power, rt)",
    "dp_fleet": "SELECT DISTINCT 'DE' AS zone, 'B' || CAST(s_nationkey % 5 AS VARCHAR) AS battery_id FROM supplier",
    "dp_level": "SELECT DISTINCT battery_id, energy, power, eta, gain, loss, "
    "round(greatest(0.0, least(1.0, x)), 10) AS lvl FROM (SELECT *, r / 2.0 + s * (k * gain - m * loss) AS x "
    "FROM dp_battery, range(25) a(k), range(25) b(m), range(3) c(r), (VALUES (1), (-1)) d(s) WHERE k + m <= 24) "
    "WHERE x BETWEEN -1e-10 AND 1 + 1e-10",
}


def schedule(days: str, prefix: str = "dp") -> dict[str, str]:
    """Queries that end in ``<prefix>_schedule`` and ``<prefix>_daily``.

    ``days``: SELECT of zone, day, utc_timestamp, actual, planning; days of other than 24 rows
    are left out.
    """
    p = prefix
    moved = "CASE WHEN l.lvl > p.lvl THEN (l.lvl - p.lvl) / l.eta ELSE (l.lvl - p.lvl) * l.eta END * l.energy"
    out = dict(FLEET)
    out[f"{p}_hours"] = (
        "SELECT *, row_number() OVER (PARTITION BY zone, day ORDER BY utc_timestamp) - 1 AS t FROM "
        f"({days}) QUALIFY count(*) OVER (PARTITION BY zone, day) = 24"
    )
    before = f"(SELECT DISTINCT zone, day, battery_id, 0.5::DOUBLE AS lvl, 0.0::DOUBLE AS val FROM {p}_hours JOIN dp_fleet USING (zone))"
    for t, name in enumerate(HOURS):
        out[f"{p}_{name}"] = (
            f"SELECT p.zone, p.day, p.battery_id, l.lvl, max(p.val - h.planning * {moved}) AS val, "
            f"arg_max(p.lvl, p.val - h.planning * {moved}) AS came FROM {before} p JOIN {p}_hours h "
            f"ON h.zone = p.zone AND h.day = p.day AND h.t = {t} JOIN dp_level l ON l.battery_id = p.battery_id "
            "AND l.lvl - p.lvl <= l.gain + 1e-9 AND p.lvl - l.lvl <= l.loss + 1e-9 GROUP BY ALL"
        )
        before = f"{p}_{name}"
    after = f"(SELECT zone, day, battery_id, 0.5::DOUBLE AS lvl FROM {before} WHERE lvl = 0.5)"
    steps = []
    for t in range(23, -1, -1):
        name = f"{p}_bk_{HOURS[t]}"
        out[name] = (
            f"SELECT n.zone, n.day, n.battery_id, d.came AS lvl, n.lvl AS reached, {t} AS t FROM {after} n "
            f"JOIN {p}_{HOURS[t]} d ON d.zone = n.zone AND d.day = n.day AND d.battery_id = n.battery_id AND d.lvl = n.lvl"
        )
        after, _ = name, steps.append(name)
    out[f"{p}_schedule"] = (
        "SELECT s.zone, s.day, s.battery_id, b.energy, h.utc_timestamp, h.actual, h.planning, "
        "least(b.power, greatest(0.0, (s.reached - s.lvl) / b.eta * b.energy)) AS charge_mw, "
        "least(b.power, greatest(0.0, (s.lvl - s.reached) * b.eta * b.energy)) AS discharge_mw, "
        f"s.reached * b.energy AS state_of_charge_mwh FROM ({' UNION ALL '.join(f'SELECT * FROM {x}' for x in steps)}) s "
        f"JOIN dp_battery b USING (battery_id) JOIN {p}_hours h ON h.zone = s.zone AND h.day = s.day AND h.t = s.t"
    )
    out[f"{p}_daily"] = (
        "SELECT zone, day, battery_id, any_value(energy) AS energy_mwh, sum((discharge_mw - charge_mw) * actual) AS revenue_eur, "
        "sum((discharge_mw - charge_mw) * planning) AS planned_revenue_eur, sum(discharge_mw) AS energy_cycled_mwh, "
        f"max(actual) - min(actual) AS price_spread_eur_mwh FROM {p}_schedule GROUP BY zone, day, battery_id"
    )
    return out


_DAY = f"CAST({local('utc_timestamp')} AS DATE)"
PERFECT = schedule(
    f"SELECT zone, {_DAY} AS day, utc_timestamp, price_eur_mwh AS actual, price_eur_mwh AS planning FROM price_hourly "
    "WHERE price_eur_mwh IS NOT NULL"
)
NAIVE = schedule(
    f"SELECT zone, {_DAY} AS day, utc_timestamp, price_eur_mwh AS actual, planning FROM (SELECT *, lag(price_eur_mwh, 24) "
    "OVER (PARTITION BY zone ORDER BY utc_timestamp) AS planning FROM price_hourly) WHERE price_eur_mwh IS NOT NULL "
    "AND planning IS NOT NULL",
    "nv",
)


def _yearly(daily: str, strategy: str) -> str:
    return (
        f"SELECT zone, battery_id, '{strategy}' AS strategy, count(*) AS days, sum(revenue_eur) AS total_eur, "
        "avg(revenue_eur) AS mean_daily_eur, avg(revenue_eur) * 365.25 AS annual_eur, "
        "avg(energy_cycled_mwh) / max(energy_mwh) AS cycles_per_day, "
        f"avg(energy_cycled_mwh) / max(energy_mwh) * 365.25 AS cycles_per_year FROM {daily} GROUP BY zone, battery_id"
    )


SUMMARY = (
    "SELECT *, annual_eur / nullif(best, 0) AS capture_rate, best - annual_eur AS forecast_value_eur FROM (SELECT y.*, "
    "p.annual_eur AS best FROM dp_yearly y JOIN dp_best p USING (zone, battery_id))"
).replace("SELECT *,", "SELECT * EXCLUDE (best),", 1)
SUMMARY_CTES = {
    **PERFECT,
    **NAIVE,
    "dp_yearly": _yearly("dp_daily", "perfect foresight") + " UNION ALL " + _yearly("nv_daily", "previous-day prices"),
    "dp_best": _yearly("dp_daily", "perfect foresight"),
}
