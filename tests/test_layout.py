"""Windowed and sorted tables: what stays, what is read, what is refused."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from noonwatt.functions.calendar import instant
from noonwatt.operators import scoring
from noonwatt.plans import marts
from noonwatt.sources import layout
from tests.conftest import partitions_read

TS = "utc_timestamp"
JAN, MARCH = dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def series(hours):
    """Two zones, hourly, January and February 2024."""
    return hours("2024-01-01 00:00:00", 24 * 60, ("A", "B")).select(
        "zone", TS, (F.col("id") % 97).cast("double").alias("v")
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("zone", TS, "v").collect())


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def folders(path):
    return sorted(f for f in os.listdir(path) if f.startswith("period="))


@pytest.mark.parametrize("unit", ["day", "month"])
@pytest.mark.parametrize(
    "start,end",
    [
        (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)),
        (dt.datetime(2024, 1, 10, 5), dt.datetime(2024, 1, 10, 9)),
        (dt.datetime(2024, 1, 20, 22), dt.datetime(2024, 2, 3, 1)),
    ],
)
def test_a_window_replaces_its_rows_only(spark, series, tmp_path, unit, start, end):
    path = str(tmp_path / "t")
    layout.create_windowed(series, path, unit)
    inside = (F.col(TS) >= instant(start)) & (F.col(TS) < instant(end))
    new = series.where(inside).withColumn("v", F.col("v") + 1000)
    want = rows(series.where(~inside).unionByName(new))
    for _ in range(2):  # a rerun gives the same rows
        assert layout.load_window(new, path, start, end, unit) == new.count()
        assert rows(layout.read_window(spark, path)) == want


def test_days_without_new_rows_are_emptied(spark, series, tmp_path):
    path = str(tmp_path / "t")
    layout.create_windowed(series, path)
    start, end = dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 14)
    new = series.where(F.to_date(TS) == "2024-01-12")
    layout.load_window(new, path, start, end)
    outside = (F.col(TS) < instant(start)) | (F.col(TS) >= instant(end))
    assert rows(layout.read_window(spark, path)) == rows(series.where(outside).unionByName(new))
    assert "period=2024-01-11" not in folders(path) and "period=2024-01-10" in folders(path)


def test_other_partitions_are_not_touched(spark, series, tmp_path):
    path = str(tmp_path / "t")
    layout.create_windowed(series, path)
    before = {f: sorted(os.listdir(tmp_path / "t" / f)) for f in folders(path)}
    start, end = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
    layout.load_window(series.where((F.col(TS) >= instant(start)) & (F.col(TS) < instant(end))), path, start, end)
    after = {f: sorted(os.listdir(tmp_path / "t" / f)) for f in folders(path)}
    assert [f for f in before if before[f] != after[f]] == ["period=2024-01-10", "period=2024-01-11"]


def test_a_first_window_makes_the_table(spark, series, tmp_path):
    path = str(tmp_path / "t")
    layout.load_window(series.where(F.col(TS) < instant("2024-02-01 00:00:00")), path, JAN, dt.datetime(2024, 2, 1), "month")
    layout.load_window(series.where(F.col(TS) >= instant("2024-02-01 00:00:00")), path, dt.datetime(2024, 2, 1), MARCH, "month")
    assert rows(layout.read_window(spark, path)) == rows(series)


def test_what_a_load_refuses_leaves_the_table(spark, series, tmp_path):
    path = str(tmp_path / "t")
    layout.create_windowed(series, path)
    start, end = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
    for bad, message in ((series.limit(0), "no rows"), (series, "outside the window"),
                         (series.withColumn(TS, F.lit(None).cast("timestamp_ntz")), "outside the window")):
        with pytest.raises(ValueError, match=message):
            layout.load_window(bad, path, start, end)
    with pytest.raises(ValueError, match="empty window"):
        layout.load_window(series, path, end, start)
    with pytest.raises(ValueError, match="unknown unit"):
        layout.load_window(series.where(F.to_date(TS) == "2024-01-10"), path, start, end, "week")
    assert rows(layout.read_window(spark, path)) == rows(series)


def test_ingest_of_a_window_keeps_history(spark, series, tmp_path):
    made = {"a": lambda: series, "b": lambda: series.withColumnRenamed(TS, "at")}
    target = str(tmp_path)
    layout.ingest_window(spark, made, target, JAN, dt.datetime(2024, 2, 1), order={"b": "at"})
    counts = layout.ingest_window(spark, made, target, dt.datetime(2024, 1, 31), MARCH, order={"b": "at"}).collect()
    assert {tuple(r) for r in counts} == {("a", 30 * 48), ("b", 30 * 48)}
    assert rows(layout.read_window(spark, target + "/a")) == rows(series)
    with pytest.raises(ValueError, match="no such"):
        layout.ingest_window(spark, made, target, JAN, MARCH, tables=["c"])


def test_a_read_of_a_window_lists_its_days_only(spark, series, tmp_path):
    path = str(tmp_path / "t")
    layout.create_windowed(series, path)
    got = layout.read_window(spark, path, dt.datetime(2024, 1, 30, 5), dt.datetime(2024, 2, 1, 3))
    assert got.columns == ["zone", TS, "v"]
    assert partitions_read(got) == [3]
    want = series.where((F.col(TS) >= instant("2024-01-30 05:00:00")) & (F.col(TS) < instant("2024-02-01 03:00:00")))
    assert rows(got) == rows(want)
    assert "PartitionFilters: [isnotnull(period" in plan(got)


def test_recent_generation_reads_recent_days(spark, series, tmp_path):
    from noonwatt import vocab

    path = str(tmp_path / "t")
    solar = series.select("zone", TS, F.col("v").alias(vocab.TARGET), F.lit(1.0).alias("solar_ac_mw"))
    layout.create_windowed(solar, path)
    now = instant("2024-02-29 00:00:00")
    got = marts.recent_generation(spark.read.parquet(path), now, days=3)
    assert partitions_read(got)[0] <= 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, marts.recent_generation(solar, now, days=3).collect()))


def test_a_log_reads_its_own_days(spark, series, tmp_path):
    path = str(tmp_path / "t")
    layout.create_windowed(series, path)
    log = series.where(F.to_date(TS).isin("2024-01-05", "2024-02-20")).where(F.hour(TS) < 2)
    got = layout.read_days_of(log, path)
    assert partitions_read(got) == [2]
    assert got.count() == 2 * 48
    assert layout.read_days_of(log.limit(0), path).count() == 0


def test_a_log_of_very_many_days_is_met_by_its_span(spark, series, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    layout.create_windowed(series, path)
    monkeypatch.setattr(layout, "MOST_DAYS", 1)
    log = series.where(F.to_date(TS).isin("2024-01-05", "2024-01-07"))
    assert layout.read_days_of(log, path).count() == 3 * 48


def test_sorted_ranges_do_not_overlap_and_are_read_in_order(spark, series, tmp_path):
    path = str(tmp_path / "t")
    layout.write_sorted(series.orderBy(F.rand(3)), path, ["zone", TS], ranges=5)
    got = layout.read_sorted(spark, path, ["zone", TS])
    assert "Exchange" not in plan(got) and "Sort" not in plan(got)
    want = sorted((r.zone, r[TS], r.v) for r in series.collect())
    assert [tuple(r) for r in got.collect()] == want
    spans = [spark.read.parquet(f).agg(F.min(F.struct("zone", TS)), F.max(F.struct("zone", TS))).head() for f in layout._files(spark, path)]
    assert all(tuple(a[1]) < tuple(b[0]) for a, b in zip(spans, spans[1:]))


def test_a_sorted_table_of_too_many_files_is_sorted_again(spark, series, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    layout.write_sorted(series, path, ["zone", TS], ranges=5)
    monkeypatch.setattr(layout, "MOST_RANGES", 2)
    got = layout.read_sorted(spark, path, ["zone", TS]).collect()
    assert [tuple(r) for r in got] == sorted((r.zone, r[TS], r.v) for r in series.collect())


def test_coverage_comes_from_footers(spark, series, tmp_path):
    paths = {}
    for name, df in (("all", series), ("one", series.where("zone = 'A'")), ("none", series.limit(0))):
        paths[name] = str(tmp_path / name)
        layout.create_windowed(df.coalesce(1), paths[name], "month")
    del paths["none"]  # no file, no footer
    got = layout.coverage_from_footers(spark, paths)
    text = plan(got)
    assert "PushedAggregation: [COUNT(*), MIN(at_second), MAX(at_second)]" in text.replace("`", "")
    last = dt.datetime(2024, 2, 29, 23)
    assert {tuple(r) for r in got.collect()} == {("all", 2880, JAN, last), ("one", 1440, JAN, last)}
    # Other reads of the session are as they were.
    assert "BatchScan" not in plan(spark.read.parquet(paths["all"]))


def test_months_and_days():
    assert list(layout._covered(dt.datetime(2024, 1, 31, 23), dt.datetime(2024, 3, 1), "month")) == [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    assert list(layout._covered(dt.datetime(2023, 12, 31, 23), dt.datetime(2024, 1, 1, 0, 0, 1), "day")) == [dt.date(2023, 12, 31), dt.date(2024, 1, 1)]


def test_scores_against_pruned_actuals(spark, series, tmp_path):
    from noonwatt import vocab

    solar = series.select("zone", TS, (F.col("v") / 100).alias(vocab.TARGET), F.lit(100.0).alias("solar_ac_mw"))
    operators = series.select("zone", TS, F.col("v").alias("solar_forecast_mw"))
    log = series.where(F.to_date(TS) == "2024-01-15").select(
        "zone", TS, F.to_date(TS).alias("target_date"), F.col(TS).alias("issued_at"), F.lit("m").alias("model_name"),
        F.lit(0.5).alias("predicted_capacity_factor"), F.lit(1.0).alias("ghi_mean_forecast"),
    )
    paths = [str(tmp_path / "s"), str(tmp_path / "o")]
    layout.create_windowed(solar, paths[0])
    layout.create_windowed(operators, paths[1])
    read = [layout.read_days_of(log, p) for p in paths]
    assert [partitions_read(df) for df in read] == [[1], [1]]
    got = scoring.score_log(log, *read)
    want = scoring.score_log(log, solar, operators)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
