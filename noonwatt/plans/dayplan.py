"""Recommendations per site and day: what the battery should do and what it is worth.

A day of a site is one row. Prices, forecast, schedule and demand travel as arrays of its
hours, so sites meet their zone's day once, not once per hour, and every figure is computed
inside the row; ``plan_hours`` unfolds it where hours are the output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import to_market
from noonwatt.functions.numbers import array_output_mw, kwh_to_mw, mw_to_kw, watts_clean
from noonwatt.functions.text import hour_list
from noonwatt.operators.ordered import join_small
from noonwatt.operators.quality import require_keys
from noonwatt.plans.dispatch import dispatch

TS = "utc_timestamp"
ZONE = ("zone",)
DAY = "target_date"
SITE = ("site_id", "battery_id", "system_kwp", "building")


def priced_hours(
    prediction: DataFrame, prices: DataFrame, keys: Sequence[str] = ZONE, strict: bool = True
) -> DataFrame:
    """Predicted hours with a published price, for days priced around the clock. With
    ``strict``, a key without any such day is an error."""
    joined = prediction.join(prices.select(*keys, TS, "price_eur_mwh"), [*keys, TS])
    counted = joined.withColumn(
        "priced_hours", F.count(F.lit(1)).over(W.partitionBy(*keys, DAY))
    )
    whole = counted.where(F.col("priced_hours") >= vocab.HOURS_PER_DAY)
    if strict:
        message = "no day has 24 priced hours to plan; the auction may be still to come"
        if prediction.isEmpty():
            raise ValueError(message)
        require_keys(prediction, whole, keys, message)
    return whole


def priced_days(priced: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Hours of ``priced_hours`` -> one row per key and day with its hours in order."""
    hour = F.struct(
        TS,
        F.hour(to_market(TS)).cast("bigint").alias("local_hour"),
        F.col("price_eur_mwh").alias("actual"),
        F.col("price_eur_mwh").alias("planning"),
        F.col("predicted_capacity_factor").alias("predicted"),
    )
    return priced.groupBy(*keys, F.col(DAY).alias("day")).agg(
        F.array_sort(F.collect_list(hour)).alias("hours")
    )


def _loads(load: DataFrame) -> DataFrame:
    """(building, day start, ts, load_kwh) rows -> one row per building and day with the
    demand in MW per instant."""
    pairs = F.struct(F.col(TS).alias("at"), kwh_to_mw("load_kwh").alias("mw"))
    return load.groupBy("building", F.to_date(to_market(TS)).alias("day")).agg(
        F.map_from_entries(F.collect_list(pairs)).alias("__load")
    )


def _with_load(days: DataFrame, load: DataFrame | None, flat_mw: float) -> DataFrame:
    """``load_mw``, an array beside ``hours``: the building's profile, else a flat draw."""
    if load is None:
        return days.withColumn("load_mw", F.transform("hours", lambda _: F.lit(flat_mw)))
    known = join_small(days, _loads(load), ["building", "day"], "left")
    drawn = F.transform(
        "hours", lambda h: F.coalesce(F.try_element_at("__load", h[TS]), F.lit(flat_mw))
    )
    return known.withColumn("load_mw", drawn).drop("__load")


def _with_solar(days: DataFrame) -> DataFrame:
    """``solar_mw`` and ``solar_value_eur``, arrays beside ``hours``.

    What solar covers of the demand is worth the price that is not paid for it.
    """
    solar = F.transform("hours", lambda h: array_output_mw(h["predicted"], F.col("system_kwp")))
    used = F.zip_with("solar_mw", "load_mw", lambda s, d: F.least(s, d))
    worth = F.zip_with(used, F.col("hours"), lambda mw, h: h["actual"] * mw)
    return days.withColumn("solar_mw", solar).withColumn("solar_value_eur", worth)


def _spread(sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sites over all cores: each becomes a row per day, and their own file may be one
    small partition. Only their narrow rows move."""
    cores = sites.sparkSession.sparkContext.defaultParallelism
    return sites.select(*keys, *SITE).repartition(cores, "site_id")


def site_days(
    priced: DataFrame,
    sites: DataFrame,
    load: DataFrame | None = None,
    keys: Sequence[str] = ZONE,
    flat_mw: float = vocab.FLAT_LOAD_MW,
) -> DataFrame:
    """Every site's priced days with its own solar output and demand, as arrays."""
    days = join_small(_spread(sites, keys), priced_days(priced, keys), keys)
    return _with_solar(_with_load(days, load, flat_mw))


def planned_days(
    prediction: DataFrame,
    prices: DataFrame,
    sites: DataFrame,
    batteries: DataFrame,
    load: DataFrame | None = None,
    keys: Sequence[str] = ZONE,
    strict: bool = True,
    flat_mw: float = vocab.FLAT_LOAD_MW,
) -> DataFrame:
    """The plan of every site and day of ``prediction``, one row each.

    A schedule depends on prices and battery size only, so it is solved once per zone, day
    and battery and shared by all sites that own one.
    """
    days = priced_days(priced_hours(prediction, prices, keys, strict), keys)
    fleet = sites.select(*keys, "battery_id").distinct().join(batteries, "battery_id")
    schedules = dispatch(days, fleet, keys).select(
        *keys, "day", "battery_id", "hours", "charge_mw", "discharge_mw", "state_of_charge_mwh"
    )
    own = join_small(_spread(sites, keys), schedules, [*keys, "battery_id"])
    full = _with_solar(_with_load(own, load, flat_mw))
    net = F.zip_with("discharge_mw", "charge_mw", lambda d, c: d - c)
    earned = F.zip_with(net, F.col("hours"), lambda mw, h: h["actual"] * mw)
    clean = {
        "predicted_solar_kw": "solar_mw",
        "expected_load_kw": "load_mw",
        "charge_kw": "charge_mw",
        "discharge_kw": "discharge_mw",
        "state_of_charge_kwh": "state_of_charge_mwh",
    }
    return full.select(
        *keys,
        "site_id",
        F.col("day").alias(DAY),
        "hours",
        *[_kw(c).alias(name) for name, c in clean.items()],
        earned.alias("battery_value_eur"),
        "solar_value_eur",
    )


def _kw(column: str) -> Column:
    return F.transform(column, lambda mw: watts_clean(mw_to_kw(mw)))


def _total(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def plan_hours(*args, **options) -> DataFrame:
    """``planned_days`` unfolded: the hour-by-hour plan of every site."""
    days = planned_days(*args, **options)
    arrays = [c for c in days.columns if c.endswith(("_kw", "_kwh", "_eur"))]
    keys = days.columns[: days.columns.index("site_id")]
    rows = days.select(*keys, "site_id", DAY, F.explode(F.arrays_zip("hours", *arrays)).alias("__h"))
    return rows.select(
        *keys,
        "site_id",
        DAY,
        F.col(f"__h.hours.{TS}").alias(TS),
        F.col("__h.hours.local_hour").alias("local_hour"),
        F.col("__h.hours.actual").alias("price_eur_mwh"),
        *[f"__h.{c}" for c in arrays],
    )


def solar_values(days: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """What solar is worth per site and day, of ``site_days``."""
    return days.select(
        *keys, "site_id", F.col("day").alias(DAY), _total("solar_value_eur").alias("solar_value_eur")
    )


def in_kw(days: DataFrame) -> DataFrame:
    """``site_days`` in the units and names of ``planned_days``."""
    return days.withColumnRenamed("day", DAY).withColumns(
        {"predicted_solar_kw": _kw("solar_mw"), "expected_load_kw": _kw("load_mw")}
    )


def day_totals(days: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Predicted generation and expected consumption per site and day, kWh."""
    return days.select(
        *keys,
        "site_id",
        DAY,
        _total("predicted_solar_kw").alias("predicted_generation_kwh"),
        _total("expected_load_kw").alias("expected_consumption_kwh"),
        F.size("hours").cast("bigint").alias("priced_hours"),
    )


def _worth() -> dict[str, Column]:
    battery, solar = _total("battery_value_eur"), _total("solar_value_eur")
    return {"revenue_eur": battery, "solar_eur": solar, "total_benefit_eur": battery + solar}


def plan_days(days: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """What each site's day is worth: battery, solar and both."""
    worth = _worth()
    return days.select(
        *keys,
        "site_id",
        DAY,
        worth["revenue_eur"].alias("revenue_eur"),
        worth["solar_eur"].alias("solar_value_eur"),
        worth["total_benefit_eur"].alias("total_benefit_eur"),
        _total("predicted_solar_kw").alias("predicted_generation_kwh"),
        _total("expected_load_kw").alias("expected_consumption_kwh"),
    )


def _hour_columns() -> dict[str, Column]:
    """Three cheapest and dearest hours and the solar peak; earlier hours win ties."""

    def best(by: Callable[[Column], Column]) -> Column:
        ranked = F.array_sort(
            F.transform("hours", lambda h: F.struct(by(h).alias("by"), h[TS].alias("at"), h["local_hour"].alias("hour")))
        )
        return hour_list(F.transform(F.slice(ranked, 1, 3), lambda h: h["hour"]))

    peaks = F.zip_with(
        "hours", "predicted_solar_kw",
        lambda h, kw: F.struct((-kw).alias("by"), h[TS].alias("at"), h["local_hour"].alias("hour"), kw.alias("kw")),
    )
    peak = F.array_min(peaks)
    return {
        "cheapest_hours": best(lambda h: h["actual"]),
        "dearest_hours": best(lambda h: -h["actual"]),
        "solar_peak_hour": peak["hour"],
        "solar_peak_kw": peak["kw"],
    }


def hour_advice(days: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    return days.select(*keys, "site_id", DAY, *[c.alias(n) for n, c in _hour_columns().items()])


def advice(days: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Plain statements a customer can act on, as an array of lines."""

    def running(column: str) -> Column:
        on = F.filter(F.arrays_zip("hours", column), lambda h: h[column] > 0.01)
        return hour_list(F.transform(on, lambda h: h["hours"]["local_hour"]))

    told = days.withColumns(
        {
            **_hour_columns(),
            **_worth(),
            "charge_hours": running("charge_kw"),
            "discharge_hours": running("discharge_kw"),
            "__day": F.date_format(DAY, "yyyy-MM-dd"),
        }
    )

    def said(name: str, *columns: str) -> Column:
        return F.format_string(vocab.ADVICE[name], *[F.col(c) for c in columns])

    lines = F.array_compact(
        F.array(
            said("prices", "cheapest_hours", "dearest_hours"),
            F.when(F.col("charge_hours") != "", said("charge", "charge_hours")),
            F.when(F.col("discharge_hours") != "", said("discharge", "discharge_hours")),
            said("solar", "solar_peak_hour", "solar_peak_kw"),
            said("benefit", "__day", "total_benefit_eur", "revenue_eur", "solar_eur"),
        )
    )
    return told.select(
        *keys, "site_id", DAY, "cheapest_hours", "dearest_hours", "charge_hours", "discharge_hours",
        "solar_peak_hour", "solar_peak_kw", "total_benefit_eur", lines.alias("advice"),
    )
