"""Battery schedules for many zones, days and batteries at once.

A day's prices travel as one short array, so the unit of work is a row: (zone,
day, battery). Spark spreads the rows; inside a task an Arrow batch of days is
solved together for each battery size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import market_date
from noonwatt.operators.explore import annualise
from noonwatt.operators.ordered import join_small, trailing_rows

TS = "utc_timestamp"
ZONE = ("zone",)
BATTERY = ("battery_id", "energy_mwh", "power_mw", "round_trip_efficiency")
SCHEDULE = (
    "charge_mw array<double>, discharge_mw array<double>, state_of_charge_mwh array<double>, "
    "planned_revenue_eur double"
)


def _solver():
    """The scheduling function as an Arrow-batched column function.

    Start and end are at half charge, one direction per hour. With the directions
    fixed the problem is linear, and an optimal path has at most one hour at
    partial power between two visits to a bound (empty, half at the ends, full).
    So it only visits levels that lie a whole number of full-power hours from a
    bound: a finite set, over which the best path is found exactly, hour by hour.
    """

    def levels(n: int, gain: float, loss: float) -> np.ndarray:
        k, m = np.meshgrid(np.arange(n + 1), np.arange(n + 1))
        moves = (k * gain - m * loss)[k + m <= n]
        moves = np.unique(np.concatenate([moves, -moves]))
        reached = (np.array([[0.0], [0.5], [1.0]]) + moves).ravel()
        reached = reached[(reached >= -1e-10) & (reached <= 1 + 1e-10)].clip(0.0, 1.0)
        reached = np.sort(np.concatenate([reached, [0.0, 0.5, 1.0]]))
        return reached[np.concatenate([[True], np.diff(reached) > 1e-10])]

    def solve(prices: np.ndarray, energy: float, power: float, round_trip: float):
        """Schedules for days (rows) by hours (columns), in MW and MWh."""
        days, n = prices.shape
        eta = round_trip**0.5
        gain, loss = eta * power / energy, power / energy / eta
        level = levels(n, gain, loss)
        size, half = len(level), int(np.argmin(np.abs(level - 0.5)))
        step = level[None, :] - level[:, None]
        bought = np.where(step > 0, step / eta, step * eta) * energy
        allowed = (step <= gain + 1e-9) & (step >= -loss - 1e-9)
        first = allowed.argmax(axis=0)
        last = size - allowed[::-1].argmax(axis=0)

        best = np.full((n + 1, days, size), -np.inf)
        best[0, :, half] = 0.0
        for t in range(n):
            price = prices[:, t, None]
            for j in range(size):
                lo, hi = first[j], last[j]
                best[t + 1, :, j] = (best[t, :, lo:hi] - price * bought[lo:hi, j]).max(axis=1)

        charge, discharge = np.zeros((days, n)), np.zeros((days, n))
        charged, at, row = np.zeros((days, n)), np.full(days, half), np.arange(days)
        for t in range(n - 1, -1, -1):
            came = best[t] - prices[:, t, None] * bought[:, at].T
            came[~allowed[:, at].T] = -np.inf
            before = came.argmax(axis=1)
            energy_in = bought[before, at]
            charge[:, t] = np.minimum(np.maximum(energy_in, 0.0), power)
            discharge[:, t] = np.minimum(np.maximum(-energy_in, 0.0), power)
            charged[:, t] = level[at] * energy
            at = before
        return charge, discharge, charged, (prices * (discharge - charge)).sum(axis=1)

    @F.pandas_udf(SCHEDULE)
    def schedule(
        prices: pd.Series, energy: pd.Series, power: pd.Series, round_trip: pd.Series
    ) -> pd.DataFrame:
        kinds = pd.DataFrame(
            {"n": prices.map(len), "e": energy, "p": power, "r": round_trip}
        ).groupby(["n", "e", "p", "r"], sort=False)
        out: list = [None] * len(prices)
        for (n, e, p, r), members in kinds.indices.items():
            # As many days at a time as keep the value table near 50 MB.
            chunk = max(1, 6_000_000 // (64 * (n + 1)))
            if r > 0 and e > 0 and p > 0:
                chunk = max(1, 6_000_000 // (len(levels(n, r**0.5 * p / e, p / e / r**0.5)) * (n + 1)))
            for start in range(0, len(members), chunk):
                part = members[start : start + chunk]
                grid = np.stack(prices.iloc[part].to_numpy()).astype(float)
                if np.isnan(grid).any():
                    raise ValueError("prices contain NaN")
                for i, *made in zip(part, *solve(grid, e, p, r), strict=True):
                    out[i] = made
        return pd.DataFrame(
            out,
            columns=["charge_mw", "discharge_mw", "state_of_charge_mwh", "planned_revenue_eur"],
        )

    return schedule


def checked_batteries(batteries: DataFrame) -> DataFrame:
    """Batteries that cannot exist stop the job, with the reason."""
    sized = (F.col("energy_mwh") > 0) & (F.col("power_mw") > 0)
    efficient = (F.col("round_trip_efficiency") > 0) & (F.col("round_trip_efficiency") <= 1)
    energy = (
        F.when(~sized, F.raise_error(F.lit("a battery needs a capacity and a power above zero")).cast("double"))
        .when(
            ~efficient,
            F.raise_error(F.lit("a battery gives back more than nothing and at most all of what it took")).cast("double"),
        )
        .otherwise(F.col("energy_mwh"))
    )
    return batteries.withColumn("energy_mwh", energy)


def price_days(
    prices: DataFrame,
    keys: Sequence[str] = ZONE,
    decision: str | None = None,
    hours: int | None = vocab.HOURS_PER_DAY,
) -> DataFrame:
    """One row per key and local day with its hours in order.

    Days that do not have exactly ``hours`` hours (clock changes, cut ends) are
    left out rather than padded.
    """
    plan = decision or "price_eur_mwh"
    known = prices.where(F.col("price_eur_mwh").isNotNull() & F.col(plan).isNotNull())
    hour = F.struct(TS, F.col("price_eur_mwh").alias("actual"), F.col(plan).alias("planning"))
    days = known.groupBy(*keys, market_date(TS).alias("day")).agg(
        F.array_sort(F.collect_list(hour)).alias("hours")
    )
    return days if hours is None else days.where(F.size("hours") == hours)


def _field(name: str) -> Column:
    return F.transform("hours", lambda h: h[name])


def dispatch(days: DataFrame, fleet: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Schedules per key, day and battery.

    ``fleet`` names the batteries of each key; every day of a key is planned for
    each of its batteries.
    """
    work = join_small(days, checked_batteries(fleet), keys)
    planned = work.withColumn(
        "__s", _solver()(_field("planning"), "energy_mwh", "power_mw", "round_trip_efficiency")
    )
    return planned.select(*days.columns, *BATTERY, "__s.*")


def schedule_hours(dispatched: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Schedules as one row per hour."""
    zipped = F.arrays_zip("hours", "charge_mw", "discharge_mw", "state_of_charge_mwh")
    rows = dispatched.select(*keys, "day", "battery_id", F.explode(zipped).alias("__h"))
    return rows.select(
        *keys,
        "day",
        "battery_id",
        F.col(f"__h.hours.{TS}").alias(TS),
        F.col("__h.hours.actual").alias("price_eur_mwh"),
        "__h.charge_mw",
        "__h.discharge_mw",
        "__h.state_of_charge_mwh",
    )


def daily_results(dispatched: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Money settled at actual prices, energy cycled and spread per day."""
    net = F.zip_with("discharge_mw", "charge_mw", lambda d, c: d - c)
    earned = F.zip_with(net, _field("actual"), lambda mw, price: mw * price)

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)

    return dispatched.select(
        *keys,
        "day",
        "battery_id",
        "energy_mwh",
        total(earned).alias("revenue_eur"),
        "planned_revenue_eur",
        total(F.col("discharge_mw")).alias("energy_cycled_mwh"),
        (F.array_max(_field("actual")) - F.array_min(_field("actual"))).alias(
            "price_spread_eur_mwh"
        ),
    )


def perfect_foresight(prices: DataFrame, fleet: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Planned and settled on the same prices: the upper bound."""
    return daily_results(dispatch(price_days(prices, keys), fleet, keys), keys)


def previous_day_prices(
    prices: DataFrame, fleet: DataFrame, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Planned on the prices of 24 rows before, settled at the actual ones."""
    shifted = trailing_rows(
        prices, keys, TS, {"__before": ("price_eur_mwh", vocab.NAIVE_PRICE_LAG_HOURS)}
    )
    return daily_results(dispatch(price_days(shifted, keys, "__before"), fleet, keys), keys)


PERFECT, NAIVE = "perfect foresight", "previous-day prices"


def strategy_summary(
    perfect: DataFrame, naive: DataFrame, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Both strategies scaled to a year, the share the naive one captures and what
    a perfect price forecast would add."""
    both = perfect.withColumn("strategy", F.lit(PERFECT)).unionByName(
        naive.withColumn("strategy", F.lit(NAIVE))
    )
    yearly = annualise(both, [*keys, "battery_id", "strategy"])
    best = F.max(F.when(F.col("strategy") == PERFECT, F.col("annual_eur"))).over(
        W.partitionBy(*keys, "battery_id")
    )
    return yearly.withColumns(
        {
            "capture_rate": F.try_divide(F.col("annual_eur"), best),
            "forecast_value_eur": best - F.col("annual_eur"),
        }
    )
