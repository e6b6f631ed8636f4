"""Raw energy tables derived from the given test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noonwatt import vocab
from noonwatt.functions.calendar import hour_start, market_date, month_start, to_market
from noonwatt.operators.ordered import running_total

# How event types stand in for series, user ids for locations.
SERIES = {
    "signup": "Solar",
    "click": "Wind onshore",
    "view": "Wind offshore",
    "purchase": "Load",
}
OTHER_SERIES = "Residual load"
DEVICES = {"signup": "grid_import", "click": "grid_export", "view": "pv", "purchase": "heat_pump"}
OTHER_DEVICE = "ev"
CAPACITY_TYPES = {
    "1-URGENT": "Solar AC",
    "2-HIGH": "Solar DC",
    "3-MEDIUM": "Wind onshore",
    "4-NOT SPECIFIED": "Wind offshore",
}
OTHER_CAPACITY, SIXTH_CAPACITY = "Battery storage (power)", "Battery storage (capacity)"
BUILDINGS = 11
METER_WRAP = 5000


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _named(column: str, names: dict[str, str], other: str) -> Column:
    out = None
    for key, name in names.items():
        hit = F.col(column) == key
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def _location() -> Column:
    names = F.array(*[F.lit(n) for n in vocab.LOCATIONS])
    return F.get(names, (F.col("user_id") % len(vocab.LOCATIONS)).cast("int"))


def _point(i: int) -> Column:
    out = None
    for name, point in vocab.LOCATIONS.items():
        hit = F.col("location") == name
        out = F.when(hit, F.lit(point[i])) if out is None else out.when(hit, F.lit(point[i]))
    return out


# Zones of unequal size that start at different times; Z0 has five users of eight.
UNEVEN = "uneven"
ZONE_STARTS = {"Z0": "2024-01-01", "Z1": "2024-01-04", "Z2": "2024-01-08", "Z3": "2024-01-12"}


def zone(zones: int | str = 1) -> Column:
    if zones == 1:
        return F.lit("DE").alias("zone")
    if zones == UNEVEN:
        named = F.greatest(F.col("user_id") % 8 - 4, F.lit(0))
        return F.concat(F.lit("Z"), named.cast("string")).alias("zone")
    return F.concat(F.lit("Z"), (F.col("user_id") % zones).cast("string")).alias("zone")


def _events(spark, sf_dir, zones: int | str = 1) -> DataFrame:
    """The events; of uneven zones those since each one's start."""
    events = table(spark, sf_dir, "events")
    if zones != UNEVEN:
        return events
    start = F.create_map(*[F.lit(x) for pair in ZONE_STARTS.items() for x in pair])
    return events.where(F.col("ts") >= F.element_at(start, zone(zones)).cast("timestamp_ntz"))


def _slot(quarters: bool) -> Column:
    """The hour of an event, or its quarter."""
    minutes = F.floor(F.minute("ts") / 15).cast("int") * 15
    return (hour_start("ts") + F.make_dt_interval(mins=minutes) if quarters else hour_start("ts")).alias("utc_timestamp")


def _last_value() -> Column:
    return F.max_by("value", "event_id")


def raw_price(spark, sf_dir, zones=1) -> DataFrame:
    return (
        _events(spark, sf_dir, zones)
        .groupBy(zone(zones), _slot(True))
        .agg((_last_value() - 20).alias("price_eur_mwh"))
    )


def raw_public_power(spark, sf_dir, zones=1, quarters=False) -> DataFrame:
    return (
        _events(spark, sf_dir, zones)
        .groupBy(
            zone(zones),
            _slot(quarters),
            _named("event_type", SERIES, OTHER_SERIES).alias("production_type"),
        )
        .agg(_last_value().alias("power_mw"))
    )


def raw_day_ahead_forecast(spark, sf_dir, zones=1, quarters=False) -> DataFrame:
    series = F.lower(F.replace(_named("event_type", SERIES, OTHER_SERIES), F.lit(" "), F.lit("_")))
    return (
        _events(spark, sf_dir, zones)
        .where(F.col("event_type") != "error")
        .groupBy(zone(zones), _slot(quarters), series.alias("production_type"))
        .agg(F.max("value").alias("forecast_mw"))
    )


def raw_weather(spark, sf_dir, zones=1) -> DataFrame:
    last = F.col("__last")
    cells = (
        _events(spark, sf_dir, zones)
        .groupBy(
            zone(zones), hour_start("ts").alias("utc_timestamp"), _location().alias("location")
        )
        .agg(_last_value().alias("__last"), F.max("value").alias("ghi_wm2"))
    )
    return cells.select(
        "zone",
        "utc_timestamp",
        "location",
        _point(0).alias("latitude"),
        _point(1).alias("longitude"),
        (last / 16 - 5).alias("temperature_c_day_ahead"),
        F.when(last < 5, 0.0).otherwise(last).alias("ghi_wm2_day_ahead"),
        (last * 0.5).alias("direct_radiation_wm2_day_ahead"),
        (last * 0.25).alias("diffuse_radiation_wm2_day_ahead"),
        (last / 8).alias("cloud_cover_pct_day_ahead"),
        (F.col("ghi_wm2") / 16 - 5).alias("temperature_c"),
        "ghi_wm2",
        (F.col("ghi_wm2") * 0.5).alias("direct_radiation_wm2"),
        (F.col("ghi_wm2") * 0.25).alias("diffuse_radiation_wm2"),
        (F.col("ghi_wm2") / 8).alias("cloud_cover_pct"),
    )


# When meters of a device are replaced by ones that stand higher.
REPLACED = {"grid_import": "2024-01-20", "pv": "2024-01-15", "ev": "2024-01-12", "heat_pump": "2024-01-18"}
HIGHER_BY = 40_000


def raw_household(spark, sf_dir, store=lambda df: df, buildings=BUILDINGS, replaced=False) -> DataFrame:
    building = F.concat(F.lit("residential"), (F.col("user_id") % buildings).cast("string"))
    hourly = (
        table(spark, sf_dir, "events")
        .groupBy(
            hour_start("ts").alias("utc_timestamp"),
            building.alias("building"),
            _named("event_type", DEVICES, OTHER_DEVICE).alias("device"),
        )
        .agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("__used"))
    )
    metered = running_total(store(hourly), ["building", "device"], "utc_timestamp", "__used", "__total")
    meter = (F.col("__total") % METER_WRAP).cast("double")
    if replaced:
        day = F.create_map(*[F.lit(x) for pair in REPLACED.items() for x in pair])
        later = F.col("utc_timestamp") >= F.try_element_at(day, F.col("device")).cast("timestamp_ntz")
        meter = meter + F.when(later, F.lit(float(HIGHER_BY))).otherwise(F.lit(0.0))
    return metered.select(
        "utc_timestamp",
        F.concat(F.lit(vocab.CHANNEL_PREFIX), "building", F.lit("_"), "device").alias("channel"),
        "building",
        F.lit("residential").alias("building_type"),
        "device",
        meter.alias("meter_kwh"),
    )


def daily_generation(spark, sf_dir) -> DataFrame:
    """Seven years of daily solar output, all seasons."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(zone(), F.col("l_shipdate").alias("utc_timestamp"))
        .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("solar_mw"))
    )


def raw_installed_power(spark, sf_dir) -> DataFrame:
    """Monthly AC capacity with May and October missing."""
    month = month_start("o_orderdate")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .where(~F.month("o_orderdate").isin(5, 10))
        .groupBy(zone(), month.alias("month"), F.lit("Solar AC").alias("production_type"))
        .agg(total.alias("capacity_mw"))
    )


def raw_capacity_types(spark, sf_dir) -> DataFrame:
    """Monthly capacity of six types, by order priority; part of the last is the sixth."""
    month = month_start("o_orderdate")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    named = _named("o_orderpriority", CAPACITY_TYPES, OTHER_CAPACITY)
    sixth = (named == OTHER_CAPACITY) & (F.col("o_orderstatus") == "F")
    kind = F.when(sixth, F.lit(SIXTH_CAPACITY)).otherwise(named)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(zone(), month.alias("month"), kind.alias("production_type"))
        .agg(total.alias("capacity_mw"))
    )


def raw_event_capacity(spark, sf_dir, zones=1) -> DataFrame:
    """AC capacity of the months the hourly series covers: 1.25 times the peak."""
    month = month_start("ts")
    return (
        _events(spark, sf_dir, zones)
        .groupBy(zone(zones), month.alias("month"), F.lit("Solar AC").alias("production_type"))
        .agg((F.max("value") * 1.25).alias("capacity_mw"))
    )


def prediction_log(spark, sf_dir, zones=1) -> DataFrame:
    """Two issues per solar hour, 24 and 12 hours ahead, by two models."""
    hours = (
        _events(spark, sf_dir, zones)
        .where(F.col("event_type") == "signup")
        .groupBy(zone(zones), hour_start("ts").alias("utc_timestamp"))
        .agg(
            F.max("value").alias("__high"),
            F.min("value").alias("__low"),
            _last_value().alias("__last"),
        )
    )
    issues = F.explode(
        F.array(
            F.struct(
                F.lit("ridge").alias("model_name"),
                F.lit(24).alias("ahead"),
                F.col("__high").alias("mw"),
            ),
            F.struct(
                F.lit("gradient_boosting").alias("model_name"),
                F.lit(12).alias("ahead"),
                F.col("__low").alias("mw"),
            ),
        )
    )
    return hours.select("*", issues.alias("i")).select(
        "zone",
        "utc_timestamp",
        to_market("utc_timestamp").alias("local_datetime"),
        (F.col("i.mw") / 700).alias("predicted_capacity_factor"),
        F.col("i.mw").alias("predicted_mw"),
        F.when(F.col("__last") < 5, 0.0).otherwise(F.col("__last")).alias("ghi_mean_forecast"),
        (F.col("utc_timestamp") - F.make_dt_interval(hours=F.col("i.ahead"))).alias("issued_at"),
        market_date("utc_timestamp").alias("target_date"),
        F.col("i.model_name").alias("model_name"),
    )


def shipping_hours(spark, sf_dir) -> DataFrame:
    """Hours of seven years, clock changes included: ship date plus an hour of day."""
    at = F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(zone(), at.alias("utc_timestamp"))
        .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("mw"))
    )


def batteries(spark: SparkSession) -> DataFrame:
    """Five home batteries (MWh, MW, round-trip efficiency)."""
    # The battery sizes the schedules are compared over.
    rows = [
        ("B0", 0.010, 0.005, 0.90),
        ("B1", 0.010, 0.003, 0.80),
        ("B2", 0.020, 0.007, 0.95),
        ("B3", 0.005, 0.005, 0.90),
        ("B4", 0.010, 0.005, 1.00),
    ]
    listed = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(b).alias("battery_id"),
                    F.lit(e).alias("energy_mwh"),
                    F.lit(p).alias("power_mw"),
                    F.lit(r).alias("round_trip_efficiency"),
                )
                for b, e, p, r in rows
            ]
        )
    )
    return spark.range(1).select(listed.alias("b")).select("b.*")


def sites(spark, sf_dir) -> DataFrame:
    """A site per supplier: its PV array, battery and building."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("site_id"),
        zone(),
        F.concat(F.lit("B"), (nation % 5).cast("string")).alias("battery_id"),
        (F.lit(4.0) + nation * 0.5).alias("system_kwp"),
        F.concat(F.lit("residential"), (key % BUILDINGS).cast("string")).alias("building"),
    )
