"""Stored quantile sketches against exact quantiles."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from noonwatt.operators import sketches
from noonwatt.sources import layout
from tests.conftest import partitions_read

TS = "utc_timestamp"


@pytest.fixture(scope="module")
def readings(hours):
    value = F.pmod(F.xxhash64("id", "zone"), F.lit(10_000)).cast("double") / 100
    return hours("2024-01-01 00:00:00", 24 * 120, ("A", "B")).select(
        "zone", TS, F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, float("nan")).otherwise(value).alias("v")
    )


def known(readings):
    pdf = readings.toPandas()
    return pdf[pdf["v"].notna()]


def test_small_sketches_are_exact(spark, readings, tmp_path):
    path = str(tmp_path / "s")
    sketches.create(readings, path, ["zone"], "v")
    got = {r.zone: (r.low, r.high) for r in sketches.quantiles(spark, path, ["zone"], {"low": 0.1, "high": 0.99}).collect()}
    for zone, part in known(readings).groupby("zone"):
        values = np.sort(part["v"].to_numpy())
        assert got[zone] == tuple(values[int(np.ceil(len(values) * q)) - 1] for q in (0.1, 0.99))


def test_large_ones_stay_within_their_bound(spark, readings, tmp_path):
    path = str(tmp_path / "s")
    size = 256
    sketches.create(readings, path, ["zone"], "v", size=size)
    wanted = {f"q{i}": i / 100 for i in (5, 25, 50, 75, 99)}
    rows = {r.zone: r for r in sketches.quantiles(spark, path, ["zone"], wanted).collect()}
    for zone, part in known(readings).groupby("zone"):
        for name, q in wanted.items():
            rank = (part["v"] <= rows[zone][name]).mean()
            assert abs(rank - q) < 2.5 / size


def test_a_refresh_reads_and_writes_its_months_only(spark, readings, tmp_path):
    path = str(tmp_path / "s")
    march = dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1)
    early = readings.where(F.col(TS) < layout._at(march[0]))
    sketches.create(early, path, ["zone"], "v")
    files = lambda m: sorted(os.listdir(f"{path}/period=2024-{m:02d}-01"))
    before = [files(1), files(2)]
    new = readings.where((F.col(TS) >= layout._at(march[0])) & (F.col(TS) < layout._at(march[1])))
    assert sketches.refresh(new, path, ["zone"], "v", *march) == 2
    assert sketches.refresh(new, path, ["zone"], "v", *march) == 2
    assert [files(1), files(2)] == before
    whole = str(tmp_path / "w")
    sketches.create(early.unionByName(new), whole, ["zone"], "v")
    ask = lambda p: sorted(map(tuple, sketches.quantiles(spark, p, ["zone"], {"m": 0.5}).collect()))
    assert ask(path) == ask(whole)


def test_quantiles_of_a_window_list_its_months(spark, readings, tmp_path):
    path = str(tmp_path / "s")
    sketches.create(readings, path, ["zone"], "v")
    got = sketches.quantiles(spark, path, ["zone"], {"m": 0.5}, dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1))
    window = layout.in_window(spark.read.parquet(path), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1), "month")
    assert partitions_read(window)[0] <= 2
    part = known(readings)
    part = part[(part[TS] >= "2024-02-01") & (part[TS] < "2024-03-01") & (part["zone"] == "A")]
    values = np.sort(part["v"].to_numpy())
    assert {r.zone: r.m for r in got.collect()}["A"] == values[int(np.ceil(len(values) * 0.5)) - 1]


def test_bounds_must_be_months(spark, readings, tmp_path):
    with pytest.raises(ValueError, match="first instant of a month"):
        sketches.refresh(readings, str(tmp_path / "s"), ["zone"], "v", dt.datetime(2024, 3, 2), dt.datetime(2024, 4, 1))


def test_no_values_have_no_row(spark, readings, tmp_path):
    path = str(tmp_path / "s")
    sketches.create(readings.withColumn("v", F.when(F.col("zone") == "A", F.col("v"))), path, ["zone"], "v")
    assert [r.zone for r in sketches.quantiles(spark, path, ["zone"], {"m": 0.5}).collect()] == ["A"]
