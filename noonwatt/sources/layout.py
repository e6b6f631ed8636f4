"""Table layouts that let a query read only what it needs.

A *windowed* table has a partition column ``period``, the day or month of its instants, so a
load of a window replaces only the partitions that the window covers, and a read of a window lists
only those. It also keeps ``at_second``, its instants as whole numbers, because Parquet's footers
answer counts, minima and maxima of numbers without any page being read.

A *sorted* table is dealt into ranges that do not overlap, sorted inside; its files follow each
other by name.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from noonwatt.functions.calendar import epoch_seconds, instant
from noonwatt.sources.tables import _filesystem, write_table

TS = "utc_timestamp"
PERIOD, SECOND = "period", "at_second"
UNITS = ("day", "month")
#: Sorted tables of more files are sorted again when they are read in order.
MOST_RANGES = 512
#: Days that are named one by one; a log that covers more is met by its first and last day.
MOST_DAYS = 1000


def period(at: Column | str, unit: str = "day") -> Column:
    """The date of the partition that holds an instant."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; one of {UNITS}")
    date = F.to_date(at)
    return date if unit == "day" else F.to_date(F.trunc(date, "month"))


def _period_of(at: dt.datetime, unit: str) -> dt.date:
    return at.date() if unit == "day" else at.date().replace(day=1)


def _next(day: dt.date, unit: str) -> dt.date:
    if unit == "day":
        return day + dt.timedelta(days=1)
    return (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


def _covered(start: dt.datetime, end: dt.datetime, unit: str) -> Iterator[dt.date]:
    day, last = _period_of(start, unit), _period_of(end - dt.timedelta(microseconds=1), unit)
    while day <= last:
        yield day
        day = _next(day, unit)


def _at(bound: Column | dt.datetime) -> Column:
    return bound if isinstance(bound, Column) else instant(bound)


def _windowed(df: DataFrame, unit: str, order: str) -> DataFrame:
    return df.withColumns({SECOND: epoch_seconds(order), PERIOD: period(order, unit)})


def load_window(
    df: DataFrame,
    path: str,
    start: dt.datetime,
    end: dt.datetime,
    unit: str = "day",
    order: str = TS,
) -> int:
    """Put ``df`` in the place of all rows of ``[start, end)``; every other row stays. Returns
    the rows loaded.

    Only the partitions that the window covers are written. Rows of its first and last
    partition that lie outside the window are carried over. The input is evaluated once;
    a row outside the window or without an instant, or no row at all, fails the load and leaves the
    table as it was. A rerun gives the same rows.
    """
    spark = df.sparkSession
    if not start < end:
        raise ValueError(f"an empty window: {start} to {end}")
    fresh, seen = _windowed(df, unit, order), Observation()
    outside = F.coalesce((F.col(order) < _at(start)) | (F.col(order) >= _at(end)), F.lit(True))
    staged = write_table(
        fresh.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(outside).alias("outside")), spark, "window"
    )
    rows, strays = seen.get["rows"], seen.get["outside"]
    if rows == 0:
        raise ValueError(f"nothing to load into {path}: the window has no rows")
    if strays:
        raise ValueError(f"{strays} rows lie outside the window {start} to {end}")

    files, at = _filesystem(spark, path)
    covered = list(_covered(start, end, unit))
    if files.exists(at(path)):
        edges = sorted({covered[0], covered[-1]})
        old = spark.read.schema(fresh.schema).parquet(path).where(F.col(PERIOD).isin(edges))
        kept = write_table(old.where(outside), spark, "edges")
        staged = staged.unionByName(kept)
    # How Spark replaces partitions: those with new rows, when the whole write has succeeded.
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)
    filled = {r[0] for r in staged.select(PERIOD).distinct().collect()}  # at most the covered periods
    for day in covered:
        folder = at(f"{path.rstrip('/')}/{PERIOD}={day}")
        if day not in filled and files.exists(folder):
            files.delete(folder, True)
    return rows


def ingest_window(
    spark: SparkSession,
    builders: dict[str, Callable[[], DataFrame]],
    target: str,
    start: dt.datetime,
    end: dt.datetime,
    tables: Sequence[str] | None = None,
    unit: str = "day",
    order: dict[str, str] | None = None,
) -> DataFrame:
    """Build the named raw tables and load their rows of ``[start, end)``; history outside the
    window stays. ``order`` names a table's time column where it is another. (table, rows)."""
    selected = list(tables or builders)
    unknown = sorted(set(selected) - set(builders))
    if unknown:
        raise ValueError(f"no such raw tables: {unknown}; there are {sorted(builders)}")
    rows = []
    for name in selected:
        at = (order or {}).get(name, TS)
        built = builders[name]().where((F.col(at) >= _at(start)) & (F.col(at) < _at(end)))
        rows.append((name, load_window(built, f"{target.rstrip('/')}/{name}", start, end, unit, at)))
    return spark.createDataFrame(rows, "table string, rows bigint")


def create_windowed(df: DataFrame, path: str, unit: str = "day", order: str = TS) -> None:
    """A new windowed table of all rows of ``df``. Rows without an instant have the null period."""
    _windowed(df, unit, order).write.partitionBy(PERIOD).parquet(path)


def in_window(df: DataFrame, start=None, end=None, unit: str = "day", order: str = TS) -> DataFrame:
    """Rows of ``[start, end)``; the bounds are also put on the partition column, so only the
    window's partitions are listed and read. ``start`` and ``end``: instants or columns."""
    if start is not None:
        df = df.where((F.col(PERIOD) >= period(_at(start), unit)) & (F.col(order) >= _at(start)))
    if end is not None:
        df = df.where((F.col(PERIOD) <= period(_at(end), unit)) & (F.col(order) < _at(end)))
    return df


def read_window(spark: SparkSession, path: str, start=None, end=None, unit: str = "day", order: str = TS) -> DataFrame:
    """Rows of ``[start, end)`` of a windowed table, without its two columns."""
    return in_window(spark.read.parquet(path), start, end, unit, order).drop(PERIOD, SECOND)


def read_days_of(log: DataFrame, path: str, order: str = TS) -> DataFrame:
    """Rows of a table with daily partitions on the days that a small ``log`` has instants of.

    The days are found first, so the scan lists their folders only and what is read is in
    proportion to the log.
    """
    spark = log.sparkSession
    days = log.select(period(order).alias("day")).where("day IS NOT NULL")
    found = [r[0] for r in days.distinct().limit(MOST_DAYS + 1).collect()]
    table = spark.read.parquet(path)
    if len(found) <= MOST_DAYS:
        return table.where(F.col(PERIOD).isin(found)).drop(PERIOD, SECOND)
    first, last = days.agg(F.min("day"), F.max("day")).head()
    return table.where(F.col(PERIOD).between(first, last)).drop(PERIOD, SECOND)


# --- sorted tables -----------------------------------------------------------------


def write_sorted(df: DataFrame, path: str, by: Sequence[str] = (TS,), ranges: int | None = None) -> None:
    """Write in ranges of ``by``, sorted inside; part numbers follow the ranges.

    ``ranges`` defaults to the session's shuffle partitions.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *by).sortWithinPartitions(*by).write.parquet(path)


def _files(spark: SparkSession, path: str) -> list[str]:
    files, at = _filesystem(spark, path)
    return sorted(
        (s.getPath().toString() for s in files.listStatus(at(path)) if s.getPath().getName().startswith("part-")),
        key=lambda p: p.rsplit("/", 1)[-1],
    )


def read_sorted(spark: SparkSession, path: str, by: Sequence[str] = (TS,)) -> DataFrame:
    """A sorted table, its rows in order, without an exchange: file after file."""
    found = _files(spark, path)
    if not 0 < len(found) <= MOST_RANGES:
        return spark.read.parquet(path).orderBy(*by)
    schema = spark.read.parquet(path).schema
    return reduce(DataFrame.union, [spark.read.schema(schema).parquet(f) for f in found])


# --- answers from file footers -------------------------------------------------------


@contextmanager
def _aggregates_pushed(spark: SparkSession) -> Iterator[None]:
    """Parquet frames made inside have scans that take aggregates."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set(key, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def coverage_from_footers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows, first and last hour of windowed tables, from the footers of their files."""
    parts = []
    with _aggregates_pushed(spark):
        for name, path in paths.items():
            counted = spark.read.parquet(path).agg(
                F.count(F.lit(1)).alias("n"), F.min(SECOND).alias("first"), F.max(SECOND).alias("last")
            )
            parts.append(counted.select(
                F.lit(name).alias("model"), "n",
                *[F.timestamp_seconds(c).cast("timestamp_ntz").alias(f"{c}_ts") for c in ("first", "last")],
            ))
    return reduce(DataFrame.unionByName, parts)
