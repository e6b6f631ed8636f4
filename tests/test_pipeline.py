"""The whole build over generated raw tables: written, audited, and refused when broken."""

import pytest
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.plans import pipeline

TS = "utc_timestamp"
DAYS = 40


@pytest.fixture(scope="module")
def raw(hours):
    base = hours("2024-03-10 00:00:00", 24 * DAYS, ("A", "B")).cache()
    wave = F.greatest(F.lit(0.0), F.sin(F.col("id") / 24 * 6.2831853)) * 50

    def long(names, column, value):
        kinds = F.explode(F.array(*[F.lit(n) for n in names])).alias("production_type")
        return base.select("zone", TS, "id", kinds).select("zone", TS, "production_type", value.alias(column))

    places = F.explode(F.array(*[F.lit(n) for n in vocab.LOCATIONS])).alias("location")
    leads = [*vocab.WEATHER_VARIABLES.values()]
    leads += [c + vocab.DAY_AHEAD_SUFFIX for c in leads]
    months = base.select("zone", F.date_trunc("MONTH", TS).cast("timestamp_ntz").alias("month")).distinct()
    return {
        "price": base.select("zone", TS, (F.col("id") % 24).cast("double").alias("price_eur_mwh")),
        "public_power": long(vocab.GENERATION_COLUMNS, "power_mw", wave),
        "day_ahead_forecast": long(vocab.OPERATOR_FORECAST_COLUMNS, "forecast_mw", wave),
        "installed_power": months.select(
            "zone", "month", F.lit("Solar AC").alias("production_type"), F.lit(100.0).alias("capacity_mw")
        ),
        "weather": base.select("zone", TS, "id", places).select(
            "zone", TS, "location", F.lit(50.0).alias("latitude"), F.lit(9.0).alias("longitude"),
            *[(F.col("id") % 24).cast("double").alias(c) for c in leads],
        ),
        "household": hours("2017-01-01 00:00:00", 24 * 20).select(
            TS, F.lit("DE_KN_residential4_grid_import").alias("channel"),
            F.lit("residential4").alias("building"), F.lit("residential").alias("building_type"),
            F.lit("grid_import").alias("device"), (F.col("id") * 0.5).alias("meter_kwh"),
        ),
    }


def test_every_model_is_built_and_audited(spark, raw, tmp_path):
    built = pipeline.build(spark, raw, str(tmp_path / "w"))
    assert len(built) == 11
    assert built["mart_solar_features"].count() == 2 * 24 * DAYS
    assert built["mart_household_features"].count() == 24 * 20 - 1
    horizons = built["mart_solar_features"].agg(F.min("horizon_hours"), F.max("horizon_hours"))
    assert tuple(horizons.collect()[0]) == (12, 35)


def test_named_models_are_built_and_a_missing_input_stops_the_build(spark, raw, tmp_path):
    built = pipeline.build(spark, {"price": raw["price"]}, str(tmp_path / "w"), models=["stg_price"])
    assert list(built) == ["stg_price"]
    with pytest.raises(KeyError, match="stg_generation needs"):
        pipeline.build(spark, {"price": raw["price"]}, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="unknown models"):
        pipeline.build(spark, raw, str(tmp_path / "u"), models=["nothing"])


def test_a_hole_in_the_grid_stops_the_build(spark, raw, tmp_path):
    broken = raw["price"].where(F.col(TS) != F.lit("2024-03-20 05:00:00").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="stg_price failed its audits .broken_grid: 2"):
        pipeline.build(spark, {"price": broken}, str(tmp_path / "w"), models=["stg_price"])
    assert spark.read.parquet(str(tmp_path / "w" / "stg_price")).count() == 2 * (24 * DAYS - 1)
