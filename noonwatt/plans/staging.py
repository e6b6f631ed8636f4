"""Staging: raw tables cleaned onto the hourly UTC grid.

Every table carries a ``zone`` (or channel, building) so that many series are
processed at once; nothing here orders a whole series inside one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import hour_start, minutes_between, month_key, to_market
from noonwatt.functions.numbers import consumption, ratio
from noonwatt.operators.ordered import join_small, previous_row
from noonwatt.operators.quantiles import exact_quantiles
from noonwatt.operators.reshape import spread, to_hours

ZONE = ("zone",)
#: Writes an intermediate result that is read more than once, and reads it back.
Store = Callable[[DataFrame], DataFrame]
TS = "utc_timestamp"


def price(raw: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Hourly day-ahead price; negative prices are real and stay."""
    known = raw.where(F.col("price_eur_mwh").isNotNull())
    return to_hours(
        known, keys, [F.avg("price_eur_mwh").alias("price_eur_mwh")], F.count(F.lit(1))
    )


def price_hourly_mean(raw: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Hourly mean of whatever is published, without the completeness rule."""
    known = raw.where(F.col("price_eur_mwh").isNotNull())
    return to_hours_any(known, keys, F.avg("price_eur_mwh").alias("price_eur_mwh"))


def to_hours_any(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys, hour_start(TS).alias(TS)).agg(*aggregates)


def _pivoted_hours(raw, keys, value, columns, counted):
    means = spread("production_type", value, columns, F.avg)
    return to_hours(raw, keys, means, F.count_if(F.col("production_type") == counted))


def generation(raw: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Hourly generation and load, one column per series; solar decides whether
    an hour is complete."""
    return _pivoted_hours(raw, keys, "power_mw", vocab.GENERATION_COLUMNS, "Solar")


def operator_forecast(raw: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """The transmission operators' published forecast, hourly."""
    return _pivoted_hours(raw, keys, "forecast_mw", vocab.OPERATOR_FORECAST_COLUMNS, "solar")


def capacity(raw: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Installed capacity by month; inverter (AC) and panel (DC) ratings apart."""
    return raw.groupBy(*keys, "month").agg(
        *spread("production_type", "capacity_mw", vocab.CAPACITY_COLUMNS, F.max)
    )


def month_capacity(hours: DataFrame, cap: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Reported capacity joined to each hour on its local month."""
    monthly = cap.select(
        *keys,
        F.to_date("month").alias("local_month"),
        F.col("solar_ac_mw").alias("reported_capacity_mw"),
    )
    placed = hours.withColumn("local_month", month_key(to_market(TS)))
    return placed.join(monthly, [*keys, "local_month"], "left")


def carried_capacity(hours: DataFrame, cap: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Capacity per local month that has hours, the last known one carried on.

    Capacity is constant within a month, so it is filled over months (twelve rows
    a year and key) instead of over hours.
    """
    months = hours.select(*keys, month_key(to_market(TS)).alias("local_month")).distinct()
    monthly = cap.select(
        *keys,
        F.to_date("month").alias("local_month"),
        F.col("solar_ac_mw").alias("reported_capacity_mw"),
    )
    upto = (
        W.partitionBy(*keys).orderBy("local_month").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return months.join(monthly, [*keys, "local_month"], "left").withColumn(
        "solar_ac_mw", F.last("reported_capacity_mw", ignorenulls=True).over(upto)
    )


def solar_output(gen: DataFrame, cap: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Measured output as a share of capacity, with late capacity carried forward."""
    local = gen.select(*keys, TS, to_market(TS).alias("local_datetime"), "solar_mw").withColumn(
        "local_month", month_key("local_datetime")
    )
    filled = join_small(local, carried_capacity(gen, cap, keys), [*keys, "local_month"])
    return filled.select(
        *keys,
        TS,
        "local_datetime",
        "solar_mw",
        "solar_ac_mw",
        ratio("solar_mw", "solar_ac_mw").alias("solar_capacity_factor"),
        F.col("reported_capacity_mw").isNull().alias("capacity_carried_forward"),
    )


def weather(raw: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Archived forecasts per location: day-ahead lead first, short lead last.

    Only the day-ahead columns may become features.
    """
    short = list(vocab.WEATHER_VARIABLES.values())
    day_ahead = [c + vocab.DAY_AHEAD_SUFFIX for c in short]
    return raw.select(*keys, TS, "location", "latitude", "longitude", *day_ahead, *short)


def location_columns(lead: str = vocab.DAY_AHEAD_SUFFIX, aggregate=F.max) -> list[Column]:
    """Irradiance per location. ``lead`` picks the day-ahead or the plain columns."""
    names = {name: f"ghi_{name}" for name in vocab.LOCATIONS}
    return spread("location", f"ghi_wm2{lead}", names, aggregate)


def national_columns(lead: str = vocab.DAY_AHEAD_SUFFIX) -> list[Column]:
    """Country-wide aggregates over the locations of an hour."""
    ghi, cloud = f"ghi_wm2{lead}", f"cloud_cover_pct{lead}"
    return [
        F.avg(ghi).alias("ghi_mean"),
        F.min(ghi).alias("ghi_min"),
        F.max(ghi).alias("ghi_max"),
        F.stddev_pop(ghi).alias("ghi_stddev"),
        (F.max(ghi) - F.min(ghi)).alias("ghi_spread"),
        F.avg(f"direct_radiation_wm2{lead}").alias("direct_radiation_mean"),
        F.avg(f"diffuse_radiation_wm2{lead}").alias("diffuse_radiation_mean"),
        F.avg(f"temperature_c{lead}").alias("temperature_mean"),
        F.avg(cloud).alias("cloud_cover_mean"),
        F.stddev_pop(cloud).alias("cloud_cover_stddev"),
    ]


def weather_national(
    long: DataFrame, keys: Sequence[str] = ZONE, lead: str = vocab.DAY_AHEAD_SUFFIX
) -> DataFrame:
    """One row per hour: nine location columns and the national aggregates."""
    return long.groupBy(*keys, TS).agg(
        *location_columns(lead),
        *national_columns(lead),
        F.count(f"ghi_wm2{lead}").alias("locations_reporting"),
    )


# --- household meters ---------------------------------------------------------

CHANNEL = ("channel",)


def meter_energy(raw: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Cumulative readings -> energy of the hour.

    Valid only across exactly one hour and without a decrease; a gap or a reset
    gives NULL.
    """
    seen = previous_row(raw, keys, TS, {"__kwh": "meter_kwh", "__ts": TS})
    one_hour = minutes_between("__ts", TS) == 60
    step = F.when(
        one_hour & (F.col("meter_kwh") >= F.col("__kwh")), F.col("meter_kwh") - F.col("__kwh")
    )
    return seen.withColumn("energy_kwh", step).drop("__kwh", "__ts")


def channel_scale(
    energy: DataFrame, keys: Sequence[str] = CHANNEL, exact: bool = False
) -> DataFrame:
    """99th percentile of hourly energy per channel: a mergeable sketch, or exact."""
    if exact:
        return exact_quantiles(energy, keys, "energy_kwh", {"p99_kwh": 0.99})
    known = energy.where(F.col("energy_kwh").isNotNull())
    return known.groupBy(*keys).agg(F.percentile_approx("energy_kwh", 0.99).alias("p99_kwh"))


def household(
    raw: DataFrame,
    keys: Sequence[str] = CHANNEL,
    exact: bool = False,
    store: Store | None = None,
) -> DataFrame:
    """Hourly energy per channel; jumps far beyond the channel's own scale are
    flagged and keep their value. The energy is read twice: ``store`` may write it."""
    energy = meter_energy(raw, keys)
    energy = store(energy) if store else energy
    limit = F.greatest(
        F.col("p99_kwh") * vocab.PLAUSIBLE_FACTOR, F.lit(vocab.PLAUSIBLE_FLOOR_KWH)
    )
    scaled = join_small(energy, channel_scale(energy, keys, exact), keys, "left")
    return scaled.select(
        *energy.columns,
        F.coalesce(F.col("energy_kwh") > limit, F.lit(False)).alias("is_implausible"),
    )


def device_energy(metered: DataFrame) -> DataFrame:
    """One row per hour and building, one column per device, flagged rows left out."""
    return (
        metered.where(~F.col("is_implausible"))
        .groupBy(TS, "building", "building_type")
        .agg(*spread("device", "energy_kwh", vocab.DEVICE_COLUMNS, F.max))
    )


def household_load(metered: DataFrame) -> DataFrame:
    """Demand per building: import plus own solar less export."""
    return (
        device_energy(metered)
        .where(F.col("grid_import_kwh").isNotNull())
        .select(
            TS,
            to_market(TS).alias("local_datetime"),
            "building",
            "building_type",
            *vocab.DEVICE_COLUMNS.values(),
            consumption("grid_import_kwh", "pv_kwh", "grid_export_kwh").alias("consumption_kwh"),
            F.col("pv_kwh").isNotNull().alias("has_pv"),
        )
    )
