"""Documents as the feeds would deliver them, written from the derived tables.

One document per local day (or per location and day), so that no document grows
with the length of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import epoch_seconds, market_date
from noonwatt.operators.reshape import spread

TS = "utc_timestamp"


def _sorted(*columns: Column | str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def _pluck(rows: str, field: str) -> Column:
    return F.transform(F.col(rows), lambda r: r[field])


def price_documents(t) -> DataFrame:
    """Prices below -19 are delivered as the text ``n/a``."""
    shown = F.when(F.col("price_eur_mwh") < -19, F.lit("n/a")).otherwise(
        F.col("price_eur_mwh").cast("string")
    )
    days = t.raw_price.groupBy("zone", market_date(TS).alias("__day")).agg(
        _sorted(epoch_seconds(TS).alias("s"), shown.alias("p")).alias("r")
    )
    doc = F.struct(_pluck("r", "s").alias("unix_seconds"), _pluck("r", "p").alias("price"))
    return days.select("zone", F.to_json(doc).alias("payload"))


def power_documents(t) -> DataFrame:
    names = {n: f"s{i}" for i, n in enumerate(vocab.GENERATION_COLUMNS)}
    hours = t.raw_public_power.groupBy("zone", TS).agg(
        *spread("production_type", "power_mw", names, F.max)
    )
    days = hours.groupBy("zone", market_date(TS).alias("__day")).agg(
        _sorted(epoch_seconds(TS).alias("s"), *names.values()).alias("r")
    )
    series = F.array(
        *[F.struct(F.lit(n).alias("name"), _pluck("r", c).alias("data")) for n, c in names.items()]
    )
    doc = F.struct(_pluck("r", "s").alias("unix_seconds"), series.alias("production_types"))
    return days.select("zone", F.to_json(doc).alias("payload"))


def forecast_documents(t) -> DataFrame:
    days = t.raw_day_ahead_forecast.groupBy(
        "zone", "production_type", market_date(TS).alias("__day")
    ).agg(_sorted(epoch_seconds(TS).alias("s"), F.col("forecast_mw").alias("v")).alias("r"))
    doc = F.struct(
        _pluck("r", "s").alias("unix_seconds"),
        _pluck("r", "v").alias("forecast_values"),
        "production_type",
        F.lit("day-ahead").alias("forecast_type"),
    )
    return days.select("zone", F.to_json(doc).alias("payload"))


def capacity_documents(t) -> DataFrame:
    """One document per year, in GW; battery power of half the months missing."""
    names = {n: f"s{i}" for i, n in enumerate(vocab.CAPACITY_COLUMNS)}
    months = t.raw_capacity_types.groupBy("zone", "month").agg(
        *spread("production_type", "capacity_mw", names, F.max)
    )
    years = months.groupBy("zone", F.year("month").alias("__year")).agg(
        _sorted(
            "month",
            F.date_format("month", "MM.yyyy").alias("label"),
            *[
                F.when((F.lit(n) != "Battery storage (power)") | (F.month("month") > 6), F.col(c) / 1000).alias(c)
                for n, c in names.items()
            ],
        ).alias("r")
    )
    series = F.array(
        *[F.struct(F.lit(n).alias("name"), _pluck("r", c).alias("data")) for n, c in names.items()]
    )
    doc = F.struct(_pluck("r", "label").alias("time"), series.alias("production_types"))
    return years.select("zone", F.to_json(doc).alias("payload"))


def weather_documents(t, archive: bool = True) -> DataFrame:
    names = {api: column for api, column in vocab.WEATHER_VARIABLES.items()}
    if archive:
        names |= {
            api + vocab.PREVIOUS_DAY_SUFFIX: column + vocab.DAY_AHEAD_SUFFIX
            for api, column in vocab.WEATHER_VARIABLES.items()
        }
    days = t.raw_weather.groupBy("zone", "location", F.to_date(TS).alias("__day")).agg(
        F.first("latitude").alias("latitude"),
        F.first("longitude").alias("longitude"),
        _sorted(F.date_format(TS, "yyyy-MM-dd'T'HH:mm").alias("time"), *names.values()).alias("r"),
    )
    hourly = F.struct(
        _pluck("r", "time").alias("time"), *[_pluck("r", c).alias(api) for api, c in names.items()]
    )
    doc = F.struct("latitude", "longitude", hourly.alias("hourly"))
    return days.select("zone", "location", F.to_json(doc).alias("payload"))


def household_wide(t) -> DataFrame:
    """One column per channel, one row per hour, blanks where a meter is silent."""
    channels = {
        f"{vocab.CHANNEL_PREFIX}residential{n}_{d}": f"{vocab.CHANNEL_PREFIX}residential{n}_{d}"
        for n in range(11)
        for d in vocab.DEVICE_COLUMNS
    }
    return t.raw_household.groupBy(TS).agg(*spread("channel", "meter_kwh", channels, F.max))
