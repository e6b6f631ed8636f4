"""Landed payload files -> raw tables.

A payload is one JSON document as fetched: parallel arrays of instants and
values. Documents are read one per row and exploded inside the tasks, so a
directory of any number of them is read in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import from_epoch, from_iso, from_month_label, market_date
from noonwatt.functions.numbers import gw_to_mw, to_number
from noonwatt.functions.text import channel_parts

TS = "utc_timestamp"
PAYLOAD = "payload"

# The layout of the landed documents. Values are read as text, since
# feeds mix numbers with words for "not available".
PRICE_SCHEMA = "unix_seconds array<bigint>, price array<string>"
POWER_SCHEMA = (
    "unix_seconds array<bigint>, production_types array<struct<name: string, data: array<string>>>"
)
FORECAST_SCHEMA = (
    "unix_seconds array<bigint>, forecast_values array<string>, production_type string, "
    "forecast_type string"
)
CAPACITY_SCHEMA = (
    "time array<string>, production_types array<struct<name: string, data: array<string>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one ``payload`` row; partition directories become columns."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", PAYLOAD)


def _parsed(documents: DataFrame, schema: str, required: Sequence[str]) -> DataFrame:
    """``doc`` beside the other columns; a document without a required field fails
    the read with the name of the field."""
    parsed = documents.withColumn("doc", F.from_json(PAYLOAD, schema)).drop(PAYLOAD)
    for name in required:
        message = F.lit(f"response has no {name}")
        present = F.when(F.col(f"doc.{name}").isNull(), F.raise_error(message).cast("boolean"))
        parsed = parsed.where(F.coalesce(present, F.lit(True)))
    return parsed


def _carried(documents: DataFrame) -> list[str]:
    return [c for c in documents.columns if c != PAYLOAD]


def _refuse(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """``df``; a row where ``bad`` holds fails the job."""
    stop = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast("boolean"))
    return df.where(F.coalesce(stop, F.lit(True)))


def _exploded(parsed: DataFrame, keep: Sequence[str], arrays: dict[str, Column]) -> DataFrame:
    """One row per position of the parallel arrays, which must be there and equally long."""
    first, *others = arrays.values()
    for name, array in list(arrays.items())[1:]:
        parsed = _refuse(parsed, array.isNull(), F.lit(f"a series has no {name}"))
        lengths = F.format_string(f"%d instants but %d values of {name}", F.size(first), F.size(array))
        parsed = _refuse(parsed, F.size(first) != F.size(array), lengths)
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    rows = parsed.select(*keep, F.explode(zipped).alias("__r"))
    return rows.select(*keep, "__r.*")


def _series(parsed: DataFrame, keep: Sequence[str], axis: str) -> DataFrame:
    """Documents with an array of named series -> (axis, name, data) rows."""
    per_series = parsed.select(
        *keep, F.col(f"doc.{axis}").alias("__axis"), F.explode("doc.production_types").alias("__s")
    )
    kept = [*keep, F.col("__s.name").alias("production_type"), "__axis",
            F.col("__s.data").alias("__data")]
    named = per_series.select(*kept)
    return _exploded(
        named,
        [*keep, "production_type"],
        {"at": F.col("__axis"), "data": F.col("__data")},
    )


def price(documents: DataFrame) -> DataFrame:
    """Day-ahead prices; unreadable values are NULL, negative ones are kept."""
    keep = _carried(documents)
    parsed = _parsed(documents, PRICE_SCHEMA, ["unix_seconds", "price"])
    rows = _exploded(
        parsed, keep, {"at": F.col("doc.unix_seconds"), "price": F.col("doc.price")}
    )
    return rows.select(
        *keep, from_epoch("at").alias(TS), to_number("price").alias("price_eur_mwh")
    )


def in_days(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows of the local days from ``first`` to ``last``, both included."""
    return df.where(market_date(TS).between(first, last))


def upcoming_price(documents: DataFrame, today: Column, days_ahead: int = 2) -> DataFrame:
    """Published prices from yesterday to ``days_ahead`` days on, without gaps filled."""
    window = in_days(price(documents), F.date_sub(today, 1), F.date_add(today, days_ahead))
    return window.where(F.col("price_eur_mwh").isNotNull())


def public_power(documents: DataFrame) -> DataFrame:
    """Production per type in long form."""
    keep = _carried(documents)
    parsed = _parsed(documents, POWER_SCHEMA, ["unix_seconds", "production_types"])
    rows = _series(parsed, keep, "unix_seconds")
    return rows.select(
        *keep, from_epoch("at").alias(TS), "production_type", to_number("data").alias("power_mw")
    )


def operator_forecast(
    documents: DataFrame, production_types: Sequence[str] = tuple(vocab.OPERATOR_FORECAST_COLUMNS)
) -> DataFrame:
    """The operators' published forecasts; each document holds one type, and all
    types are read in one pass."""
    keep = _carried(documents)
    parsed = _parsed(
        documents, FORECAST_SCHEMA, ["unix_seconds", "forecast_values", "production_type"]
    ).where(F.col("doc.production_type").isin(*production_types))
    named = parsed.withColumn("production_type", F.col("doc.production_type"))
    arrays = {"at": F.col("doc.unix_seconds"), "forecast_values": F.col("doc.forecast_values")}
    rows = _exploded(named, [*keep, "production_type"], arrays)
    return rows.select(
        *keep, from_epoch("at").alias(TS), "production_type", to_number("forecast_values").alias("forecast_mw")
    )


def installed_power(documents: DataFrame) -> DataFrame:
    """Monthly capacity in MW from month labels and GW; missing months stay NULL."""
    keep = _carried(documents)
    parsed = _parsed(documents, CAPACITY_SCHEMA, ["time", "production_types"])
    rows = _series(parsed, keep, "time")
    return rows.select(
        *keep,
        from_month_label("at").alias("month"),
        "production_type",
        gw_to_mw("data").alias("capacity_mw"),
    )


# --- weather ------------------------------------------------------------------------------


def _weather_names(archive: bool) -> dict[str, str]:
    names = dict(vocab.WEATHER_VARIABLES)
    if archive:
        names |= {
            api + vocab.PREVIOUS_DAY_SUFFIX: column + vocab.DAY_AHEAD_SUFFIX
            for api, column in vocab.WEATHER_VARIABLES.items()
        }
    return names


def _weather(documents: DataFrame, names: dict[str, str]) -> DataFrame:
    keep = _carried(documents)
    fields = ", ".join(f"{api}: array<string>" for api in ["time", *names])
    schema = f"latitude double, longitude double, hourly struct<{fields}>"
    parsed = _parsed(documents, schema, ["hourly", "hourly.time", *[f"hourly.{api}" for api in names]])
    placed = parsed.select(
        *keep, F.col("doc.latitude").alias("latitude"), F.col("doc.longitude").alias("longitude"), "doc"
    )
    arrays = {"at": F.col("doc.hourly.time")}
    arrays |= {column: F.col(f"doc.hourly.{api}") for api, column in names.items()}
    rows = _exploded(placed, [*keep, "latitude", "longitude"], arrays)
    return rows.select(
        *keep,
        from_iso("at").alias(TS),
        "latitude",
        "longitude",
        *[to_number(column).alias(column) for column in names.values()],
    )


def require_locations(documents: DataFrame, locations: Sequence[str] = tuple(vocab.LOCATIONS)) -> None:
    """Stop when a wanted location never landed."""
    landed = documents.where(F.col("location").isin(*locations)).select("location").distinct()
    found = {r["location"] for r in landed.collect()}  # at most the wanted ones
    if missing := sorted(set(locations) - found):
        raise ValueError(f"wanted {len(locations)} locations, got {len(found)}; missing: {missing}")


def weather_archive(
    documents: DataFrame, start: str = vocab.WEATHER_START, locations: Sequence[str] = ()
) -> DataFrame:
    """Archived forecasts per location at both lead times. ``documents`` carry a
    ``location`` column; a document that lacks a variable fails the read, and so does a
    missing one of the ``locations``, if any are named."""
    if locations:
        require_locations(documents, locations)
    if str(start) < vocab.WEATHER_ARCHIVE_START:
        raise ValueError(f"the archive starts {vocab.WEATHER_ARCHIVE_START}; got start={start}")
    rows = _weather(documents, _weather_names(archive=True))
    return rows.where(F.col(TS) >= F.lit(str(start)).cast("timestamp_ntz"))


def weather_forward(
    documents: DataFrame, today: Column, days: int = 3, past_days: int = 1
) -> DataFrame:
    """Forecasts for the coming days, plain columns only.

    ``past_days`` reaches back because a local day begins before midnight UTC.
    """
    rows = _weather(documents, _weather_names(archive=False))
    day = F.to_date(TS)
    return rows.where(day.between(F.date_sub(today, past_days), F.date_add(today, days - 1)))


# --- household meters ----------------------------------------------------------------------


def channel_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith(vocab.CHANNEL_PREFIX)]


def read_household_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide meter file; every column as text, so that no pass infers types."""
    return spark.read.csv(path, header=True)


def household(wide: DataFrame) -> DataFrame:
    """Wide meter readings -> one row per hour and channel that has a reading."""
    channels = channel_columns(wide)
    if not channels:
        raise KeyError(f"no column starts with {vocab.CHANNEL_PREFIX}")
    typed = wide.select(from_iso(F.col(TS).cast("string")).alias(TS),
                        *[to_number(c).alias(c) for c in channels])
    long = typed.unpivot(TS, channels, "channel", "meter_kwh").where(F.col("meter_kwh").isNotNull())
    return long.select("*", *[c.alias(n) for n, c in channel_parts("channel").items()])


def builders(
    documents: dict[str, DataFrame], start: str = vocab.DATA_START, end: str | None = None
) -> dict:
    """Table name -> function that builds it, within the date window.

    Weather starts later than the rest and the meters are independent of it.
    """

    def window(df: DataFrame) -> DataFrame:
        df = df.where(market_date(TS) >= F.lit(start).cast("date"))
        return df if end is None else df.where(market_date(TS) <= F.lit(end).cast("date"))

    made = {
        "price": lambda: window(price(documents["price"])),
        "public_power": lambda: window(public_power(documents["public_power"])),
        "day_ahead_forecast": lambda: window(operator_forecast(documents["day_ahead_forecast"])),
        "installed_power": lambda: installed_power(documents["installed_power"]),
        "weather": lambda: window(
            weather_archive(documents["weather"], max(start, vocab.WEATHER_START))
        ),
        "household": lambda: household(documents["household"]),
    }
    return {name: build for name, build in made.items() if name in documents}
