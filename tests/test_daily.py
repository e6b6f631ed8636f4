"""The daily run: forecast, log and plan in one call."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_forecast import frame, history, local, weather  # noqa: F401

from noonwatt import vocab
from noonwatt.plans import daily
from noonwatt.sources import payloads

TS = "utc_timestamp"
NOW = "2026-08-01 20:00:00"


@pytest.fixture(scope="module")
def inputs(spark, hours):
    prices = hours("2026-08-01 00:00:00", 96).select("zone", TS, (F.col("id") % 24).cast("double").alias("price_eur_mwh"))
    sites = spark.createDataFrame([(1, "A", "B0", 5.0, "b1")], "site_id bigint, zone string, battery_id string, system_kwp double, building string")
    batteries = spark.createDataFrame([("B0", 0.01, 0.005, 0.9)], "battery_id string, energy_mwh double, power_mw double, round_trip_efficiency double")
    return prices, sites, batteries, F.lit(NOW).cast("timestamp_ntz")


def mean():
    return lambda x, y, new: np.full(len(new), y.mean())


def test_forecast_log_and_plan(frame, history, weather, inputs, spark, tmp_path):  # noqa: F811
    prices, sites, batteries, now = inputs
    log = str(tmp_path / "log")
    for _ in range(2):
        done = daily.run(frame, history, weather, prices, sites, batteries, now, log, forecaster=mean(), model_name="mean")
    assert done.prediction.count() == 24
    assert spark.read.parquet(log).count() == 48
    row = done.advice.collect()[0]
    assert str(row.target_date) == "2026-08-02" and row.advice[0].startswith("Cheapest power at")
    assert done.plan.count() == 1


def test_what_stops_the_run(frame, history, weather, inputs, tmp_path):  # noqa: F811
    prices, sites, batteries, now = inputs
    args = (sites, batteries, now, str(tmp_path / "log"))
    early = history.where(F.col(TS) < F.lit("2026-07-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="history ends at .A: 2026-06-30 23:00:00"):
        daily.run(frame, early, weather, prices, *args, forecaster=mean())
    with pytest.raises(ValueError, match="24 priced hours"):
        daily.run(frame, history, weather, prices.limit(0), *args, forecaster=mean())


def test_a_location_that_never_landed_is_named(spark):
    landed = spark.createDataFrame([(n, "{}") for n in list(vocab.LOCATIONS)[1:]], "location string, payload string")
    with pytest.raises(ValueError, match=f"wanted {len(vocab.LOCATIONS)} locations"):
        payloads.weather_archive(landed, locations=tuple(vocab.LOCATIONS))


def test_another_day_without_saving(frame, history, weather, inputs, tmp_path):  # noqa: F811
    prices, sites, batteries, now = inputs
    log = tmp_path / "log"
    done = daily.run(frame, history, weather, prices, sites, batteries, now, str(log), forecaster=mean(),
                     day=F.lit("2026-08-03").cast("date"), save=False)
    assert {str(r[0]) for r in done.prediction.select("target_date").distinct().collect()} <= {"2026-08-03"}
    assert not log.exists()
