"""A refreshed mart equals a full build, and reads the halo only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import instant
from noonwatt.plans import incremental, marts
from noonwatt.sources import layout
from tests.conftest import partitions_read, same

TS = "utc_timestamp"
FROM, UPTO = dt.datetime(2024, 5, 1, 7), dt.datetime(2024, 5, 3, 2)


def tables(at):
    noise = F.pmod(F.xxhash64("id", "zone"), F.lit(1000)) / 1000
    solar = at.select("zone", TS, F.col(TS).alias("local_datetime"), (noise * 100).alias("solar_mw"),
                      F.lit(100.0).alias("solar_ac_mw"), noise.alias(vocab.TARGET))
    national = at.select("zone", TS, *[noise.alias(c) for c in vocab.WEATHER_FEATURES], F.lit(9).alias("locations_reporting"))
    return solar, national, at.select("zone", TS, (noise * 90).alias("solar_forecast_mw"))


@pytest.fixture(scope="module")
def world(hours):
    """200 days; zone B has holes, so its positions are not its hours."""
    at = hours("2024-02-01 00:00:00", 24 * 200, ("A", "B"))
    return tables(at.where((F.col("zone") == "A") | (F.col("id") % 5 != 0)))


def built(world, tmp_path, name):
    paths = [str(tmp_path / f"{name}{i}") for i in range(3)]
    for df, path in zip(world, paths):
        layout.create_windowed(df, path)
    return paths


@pytest.mark.parametrize("change", ["values", "missing", "added"])
def test_a_late_correction_equals_a_full_build(spark, world, tmp_path, change):
    solar, national, operators = world
    inside = (F.col(TS) >= instant(FROM)) & (F.col(TS) < instant(UPTO))
    if change == "values":
        old = solar.withColumn(vocab.TARGET, F.when(inside, 0.5).otherwise(F.col(vocab.TARGET)))
        new = solar
    elif change == "missing":  # rows that had not arrived
        old, new = solar.where(~(inside & (F.hour(TS) % 3 == 0))), solar
    else:  # rows that go away
        old, new = solar, solar.where(~(inside & (F.hour(TS) % 3 == 0)))
    paths = built((old, national, operators), tmp_path, "in")
    mart = str(tmp_path / "mart")
    layout.create_windowed(marts.solar_features(old, national, operators), mart)
    layout.load_window(new.where(inside), paths[0], FROM, UPTO)
    n = incremental.refresh_solar_features(spark, mart, *paths, FROM, UPTO)
    full = marts.solar_features(new, national, operators)
    same(layout.read_window(spark, mart), full, ["zone", TS], 1e-9)
    assert 0 < n < full.count() / 2


def test_only_the_halo_is_read_and_written(spark, world, tmp_path):
    import os

    paths = built(world, tmp_path, "in")
    mart = str(tmp_path / "mart")
    layout.create_windowed(marts.solar_features(*world), mart)
    first, upto = incremental._span(spark, mart, ("zone",), FROM, UPTO, incremental.SOLAR_REACH)
    # Zone B has four rows of five, so 767 rows are 40 days.
    assert first == dt.datetime(2024, 3, 22) and upto == dt.datetime(2024, 6, 13)
    stamp = lambda d: os.stat(f"{mart}/period={d}").st_mtime_ns
    before = {d: stamp(d) for d in ("2024-04-30", "2024-05-01", "2024-06-12", "2024-06-13")}
    read = layout.read_window(spark, paths[0], first, upto)
    assert partitions_read(read)[0] <= (upto - first).days + 1
    incremental.refresh_solar_features(spark, mart, *paths, FROM, UPTO)
    assert [d for d in before if stamp(d) != before[d]] == ["2024-05-01", "2024-06-12"]


def test_a_refresh_at_the_end_may_add_days(spark, world, tmp_path):
    solar, national, operators = world
    cut = dt.datetime(2024, 8, 10)
    early = [df.where(F.col(TS) < instant(cut)) for df in world]
    paths = built(early, tmp_path, "in")
    mart = str(tmp_path / "mart")
    layout.create_windowed(marts.solar_features(*early), mart)
    end = dt.datetime(2024, 9, 1)
    for df, path in zip(world, paths):
        layout.load_window(df.where(F.col(TS) >= instant(cut)), path, cut, end)
    incremental.refresh_solar_features(spark, mart, *paths, cut, end)
    same(layout.read_window(spark, mart), marts.solar_features(*world), ["zone", TS], 1e-9)


def test_household_features_are_refreshed_alike(spark, hours, tmp_path):
    at = hours("2024-02-01 00:00:00", 24 * 90, ("b1", "b2"))
    load = at.where((F.col("zone") == "b1") | (F.col("id") % 7 != 0)).select(
        TS, F.col(TS).alias("local_datetime"), F.col("zone").alias("building"), F.lit("x").alias("building_type"),
        *[(F.pmod(F.xxhash64("id", "zone"), F.lit(100)) / 10).alias(c) for c in vocab.DEVICE_COLUMNS.values()],
        (F.pmod(F.xxhash64("id"), F.lit(90)) / 10 - 1).alias("consumption_kwh"), F.lit(True).alias("has_pv"),
    )
    start, end = dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 12, 5)
    inside = (F.col(TS) >= instant(start)) & (F.col(TS) < instant(end))
    old = load.withColumn("consumption_kwh", F.when(inside, 1.0).otherwise(F.col("consumption_kwh")))
    paths = [str(tmp_path / n) for n in ("load", "mart")]
    layout.create_windowed(load, paths[0])
    layout.create_windowed(marts.household_features(old), paths[1])
    incremental.refresh_household_features(spark, paths[1], paths[0], start, end)
    same(layout.read_window(spark, paths[1]), marts.household_features(load), ["building", TS], 1e-9)


def test_reaches():
    assert incremental.SOLAR_REACH == 767 and incremental.LOAD_REACH == 215
