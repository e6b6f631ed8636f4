"""Registered queries over other fixtures: several uneven zones, replaced meters, quarter hours.

The functions are those of the plain queries. The SQL of several zones is the plain SQL of each
zone alone, over that zone's events: what one pass over all zones gives must be what every
zone gives by itself.
"""

from __future__ import annotations

import inspect
import re
from functools import cached_property

from workload import adapters
from workload.registry import MADE, ORACLE, QUERIES, over
from workload.tables import Tables


class Zoned(Tables):
    """Four zones of unequal size that start at different times."""

    zones = tuple(adapters.ZONE_STARTS)

    def __getattr__(self, name):
        maker = getattr(adapters, name, None)
        if name.startswith("_") or maker is None or "zones" not in inspect.signature(maker).parameters:
            return super().__getattr__(name)
        frame = maker(self.spark, self.sf_dir, zones=adapters.UNEVEN)
        self.__dict__[name] = frame
        return frame


class Replaced(Tables):
    """Meters of two buildings, read nearly every hour; some are replaced by ones that stand higher."""

    @cached_property
    def raw_household(self):
        return adapters.raw_household(self.spark, self.sf_dir, self.keep, buildings=2, replaced=True)


class Quarters(Tables):
    """Generation and forecast in quarter hours."""

    def __getattr__(self, name):
        if name not in ("raw_public_power", "raw_day_ahead_forecast"):
            return super().__getattr__(name)
        frame = getattr(adapters, name)(self.spark, self.sf_dir, quarters=True)
        self.__dict__[name] = frame
        return frame


def _zoned_sql(sql: str) -> str:
    parts, shares = [], []
    for i, (name, start) in enumerate(adapters.ZONE_STARTS.items()):
        users = "user_id % 8 < 5" if i == 0 else f"user_id % 8 = {4 + i}"
        shares.append(f"events_{name} AS (SELECT * FROM events WHERE {users} AND ts >= TIMESTAMP '{start}')")
        own = re.sub(r"\bevents\b", f"events_{name}", sql)
        parts.append(f"SELECT * REPLACE ('{name}' AS zone) FROM ({own})")
    return f"WITH {', '.join(shares)}\n" + "\nUNION ALL\n".join(parts)


ZONED = (
    "agg_price_hourly agg_price_mean_hour agg_generation_pivot agg_tso_pivot agg_weather_national "
    "mart_solar_features mart_from_buckets refresh_solar_mart load_window "
    "join_weather_inner join_benchmark_left join_interval_self antijoin_coverage "
    "win_cf_lags win_cf_mean_7d win_latest_issue win_step_minutes win_rolling_time win_shift_24h "
    "lag_join asof_backward folds backtest backtest_summary score_predictions "
    "src_price src_upcoming_price src_public_power src_tso_forecast src_weather_archive src_weather_forward "
    "dispatch_perfect"
).split()

for _name in ZONED:
    QUERIES[f"zoned_{_name}"] = over(_name, Zoned)
    ORACLE[f"zoned_{_name}"] = _zoned_sql(ORACLE[_name])


def _replaced_sql(sql: str) -> str:
    days = " ".join(f"WHEN '{d}' THEN TIMESTAMP '{day}'" for d, day in adapters.REPLACED.items())
    higher = f" + CASE WHEN utc_timestamp >= CASE device {days} END THEN {float(adapters.HIGHER_BY)}::DOUBLE ELSE 0 END"
    fewer = sql.replace("user_id % 11", "user_id % 2")
    changed, n = re.subn(r"(% 5000 AS DOUBLE\))(\s+AS meter_kwh)", rf"\1{higher}\2", fewer)
    assert n == 1 and fewer != sql
    return changed


for _name in "win_meter_diff stg_household stg_household_load agg_meter_summary agg_device_pivot mart_household_features".split():
    QUERIES[f"replaced_{_name}"] = over(_name, Replaced)
    ORACLE[f"replaced_{_name}"] = _replaced_sql(ORACLE[_name])


def _quarters_sql(sql: str) -> str:
    quarter = "date_trunc('hour', ts) + INTERVAL '15' MINUTE * CAST(floor(minute(ts) / 15) AS INT) AS utc_timestamp"
    changed, n = re.subn(r"date_trunc\('hour', ts\) AS utc_timestamp", quarter, sql)
    assert n == 1
    return changed


for _name in ("agg_generation_pivot", "agg_tso_pivot"):
    QUERIES[f"quarters_{_name}"] = over(_name, Quarters)
    ORACLE[f"quarters_{_name}"] = _quarters_sql(ORACLE[_name])
