"""Sources and sinks, over documents and tables derived from the test tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from noonwatt.functions.calendar import instant, market_date
from noonwatt.session import shared_folder
from noonwatt.sources import catalog, layout, payloads, tables
from workload import payload_docs as docs
from workload.ctes import local
from workload.registry import register

TS = "utc_timestamp"
TODAY = "2024-01-15"
PRICE_ROWS = (
    "SELECT zone, utc_timestamp, CASE WHEN price_eur_mwh < -19 THEN NULL ELSE price_eur_mwh END "
    "AS price_eur_mwh FROM raw_price"
)


def _landed(documents):
    """Written as files, one document each, and read back as a feed's landing folder is."""
    spark = documents.sparkSession
    path = os.path.join(shared_folder(spark), "landed")
    keys = [c for c in documents.columns if c != "payload"]
    documents.write.partitionBy(*keys).option("maxRecordsPerFile", 1).text(path)
    return payloads.read_documents(spark, path)


def _landed_csv(wide):
    """The meter file as it is delivered, read back column by column as text."""
    path = os.path.join(shared_folder(wide.sparkSession), "meters")
    wide.write.csv(path, header=True)
    return payloads.read_household_csv(wide.sparkSession, path)


def _day(text: str):
    return F.lit(text).cast("date")


@register("src_price", PRICE_ROWS, "price_eur_mwh")
def src_price(t):
    return payloads.price(_landed(docs.price_documents(t)))


@register(
    "src_upcoming_price",
    f"SELECT * FROM price_rows WHERE price_eur_mwh IS NOT NULL AND CAST({local('utc_timestamp')} AS DATE) "
    f"BETWEEN DATE '{TODAY}' - 1 AND DATE '{TODAY}' + 2",
    "price_eur_mwh",
    price_rows=PRICE_ROWS,
)
def src_upcoming_price(t):
    return payloads.upcoming_price(_landed(docs.price_documents(t)), _day(TODAY))


POWER_ROWS = (
    "SELECT h.zone, h.utc_timestamp, n.production_type, p.power_mw FROM (SELECT DISTINCT zone, "
    "utc_timestamp FROM raw_public_power) h CROSS JOIN (SELECT DISTINCT production_type FROM "
    "raw_public_power) n LEFT JOIN raw_public_power p USING (utc_timestamp, production_type)"
)


@register("src_public_power", POWER_ROWS)
def src_public_power(t):
    return payloads.public_power(_landed(docs.power_documents(t)))


FORECAST_ROWS = (
    "SELECT zone, utc_timestamp, production_type, forecast_mw FROM raw_day_ahead_forecast "
    "WHERE production_type IN ('solar', 'wind_onshore', 'wind_offshore', 'load')"
)


@register("src_tso_forecast", FORECAST_ROWS)
def src_tso_forecast(t):
    return payloads.operator_forecast(_landed(docs.forecast_documents(t)))


CAPACITY_ROWS = (
    "SELECT m.zone, m.month, n.production_type, CASE WHEN n.production_type = 'Battery storage (power)' AND "
    "month(m.month) <= 6 THEN NULL ELSE c.capacity_mw / 1000 * 1000 END AS capacity_mw FROM (SELECT DISTINCT zone, "
    "month FROM raw_capacity_types) m CROSS JOIN (SELECT DISTINCT production_type FROM "
    "raw_capacity_types) n LEFT JOIN raw_capacity_types c USING (month, production_type)"
)


@register("src_installed_power", CAPACITY_ROWS, "capacity_mw:4")
def src_installed_power(t):
    return payloads.installed_power(_landed(docs.capacity_documents(t)))


@register("src_weather_archive", "SELECT * FROM raw_weather")
def src_weather_archive(t):
    return payloads.weather_archive(_landed(docs.weather_documents(t)))


@register(
    "src_weather_forward",
    "SELECT zone, utc_timestamp, location, latitude, longitude, temperature_c, ghi_wm2, "
    "direct_radiation_wm2, diffuse_radiation_wm2, cloud_cover_pct FROM raw_weather WHERE "
    f"CAST(utc_timestamp AS DATE) BETWEEN DATE '{TODAY}' - 1 AND DATE '{TODAY}' + 2",
)
def src_weather_forward(t):
    return payloads.weather_forward(_landed(docs.weather_documents(t, archive=False)), _day(TODAY))


@register(
    "src_household_long",
    "SELECT utc_timestamp, channel, meter_kwh, building, building_type, device FROM raw_household",
)
def src_household_long(t):
    return payloads.household(_landed_csv(docs.household_wide(t)))


@register(
    "ingest_tables",
    f"SELECT 'price' AS \"table\", count(*) AS rows FROM ({PRICE_ROWS}) UNION ALL SELECT 'public_power', "
    f"count(*) FROM ({POWER_ROWS}) UNION ALL SELECT 'day_ahead_forecast', count(*) FROM ({FORECAST_ROWS}) "
    f"UNION ALL SELECT 'installed_power', count(*) FROM ({CAPACITY_ROWS}) UNION ALL SELECT 'weather', "
    "count(*) FROM raw_weather UNION ALL SELECT 'household', count(*) FROM raw_household",
)
def ingest_tables(t):
    """From landed files."""
    documents = {
        "price": _landed(docs.price_documents(t)),
        "public_power": _landed(docs.power_documents(t)),
        "day_ahead_forecast": _landed(docs.forecast_documents(t)),
        "installed_power": _landed(docs.capacity_documents(t)),
        "weather": _landed(docs.weather_documents(t)),
        "household": _landed_csv(docs.household_wide(t)),
    }
    return tables.ingest(t.spark, payloads.builders(documents), shared_folder(t.spark))


@register("sink_replace", "raw_price")
def sink_replace(t):
    """Loaded twice: the second load replaces the first."""
    path = os.path.join(shared_folder(t.spark), "price")
    tables.replace_table(t.raw_price, path)
    tables.replace_table(t.raw_price, path)
    return t.spark.read.parquet(path)


@register(
    "sink_append_predictions",
    "SELECT zone, utc_timestamp, local_datetime, predicted_capacity_factor, predicted_mw, "
    "ghi_mean_forecast, issued_at, target_date, model_name FROM prediction_log",
)
def sink_append_predictions(t):
    """Two models' issues appended one after the other; both stay."""
    path = os.path.join(shared_folder(t.spark), "solar_predictions")
    for model in ("ridge", "gradient_boosting"):
        issue = t.prediction_log.where(F.col("model_name") == model).drop("model_name")
        tables.save_predictions(issue, path, model)
    return tables.load_predictions(t.spark, path)


@register(
    "scan_ordered",
    "SELECT zone, utc_timestamp, price_eur_mwh FROM price_hourly ORDER BY utc_timestamp",
    "price_eur_mwh",
)
def scan_ordered(t):
    """Written in sorted ranges, so that reading in order takes no sort."""
    path = os.path.join(shared_folder(t.spark), "price_hourly")
    layout.write_sorted(t.price_hourly, path)
    return layout.read_sorted(t.spark, path)


@register(
    "param_query",
    "SELECT event_type, count(*) AS n, max(value) AS top FROM events WHERE value > 12.5 AND "
    "ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'error' GROUP BY event_type",
)
def param_query(t):
    import datetime as dt

    t.given("events").createOrReplaceTempView("noonwatt_events")
    return tables.query(
        t.spark,
        "SELECT event_type, count(*) AS n, max(value) AS top FROM noonwatt_events "
        "WHERE value > :least AND ts >= :since AND event_type <> :skip GROUP BY event_type",
        least=12.5,
        since=dt.datetime(2024, 1, 10),
        skip="error",
    )


@register(
    "catalog_meta",
    "SELECT 'raw.price' AS \"table\", count(*) AS rows, CAST(3 AS BIGINT) AS columns FROM raw_price UNION ALL SELECT "
    "'staging.stg_generation', count(*), 8 FROM stg_generation UNION ALL SELECT "
    "'raw.household', count(*), 6 FROM raw_household",
)
def catalog_meta(t):
    """Tables registered in the catalog, found there by schema and name."""
    for name, df in (("raw.price", t.raw_price), ("raw.household", t.raw_household), ("staging.stg_generation", t.stg_generation)):
        catalog.register_table(df, f"noonwatt_{name}")
    found = catalog.describe(t.spark, "noonwatt_raw", "[ph]*").unionByName(
        catalog.describe(t.spark, "noonwatt_staging", "stg_generation")
    )
    return found.withColumn("table", F.regexp_replace("table", "^noonwatt_", ""))


@register(
    "catalog_columns",
    "SELECT 'stg_tso' AS \"table\", unnest(['solar_forecast_mw', 'wind_onshore_forecast_mw', "
    "'wind_offshore_forecast_mw', 'load_forecast_mw']) AS \"column\", 'double' AS type FROM (SELECT 1 FROM stg_tso LIMIT 1)",
)
def catalog_columns(t):
    """The columns of a registered table whose names end in ``_mw``, with their types."""
    catalog.register_table(t.stg_tso, "noonwatt_columns.stg_tso")
    found = catalog.matching_columns(t.spark, "noonwatt_columns", "stg_*", "*_mw")
    return found.withColumn("table", F.substring_index("table", ".", -1))
