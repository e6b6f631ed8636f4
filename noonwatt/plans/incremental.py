"""Marts brought up to date without being built anew.

A corrected stretch of history changes its own rows, and by lags and trailing means those of
the next rows. Rows before it only lend their values. So a refresh reads the stretch with a
halo of as many rows as the longest look-back on either side, computes those rows, and
replaces the periods of the stretch and of the halo after it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.plans import marts
from noonwatt.sources import layout

#: (path, first, last) -> the rows of a windowed table in that window.
Read = Callable[[str, dt.datetime, dt.datetime], DataFrame]


def reach(lags: dict[str, int], means: dict[str, tuple[int, int]]) -> int:
    """Rows that the longest look-back goes back."""
    return max([*lags.values(), *[first for first, _ in means.values()]])


SOLAR_REACH = reach(marts.SOLAR_LAGS, marts.SOLAR_MEANS)
LOAD_REACH = reach(marts.LOAD_LAGS, marts.LOAD_MEANS)


def halo(
    mart: DataFrame, keys: Sequence[str], start: dt.datetime, end: dt.datetime, rows: int
) -> tuple[dt.date | None, dt.date | None]:
    """The first and last day that hold, for every key, ``rows`` rows before and after
    ``[start, end)``; None where a key has fewer. ``mart``: a windowed table with daily partitions.

    Positions count, not hours, so holes widen the halo. Only days are counted, and the
    counts of whole days come from one column.
    """
    per_day = mart.where(F.col(layout.PERIOD).isNotNull()).groupBy(*keys, layout.PERIOD)
    counts = per_day.agg(
        F.count_if(F.col(layout.TS) < layout._at(start)).alias("before"),
        F.count_if(F.col(layout.TS) >= layout._at(end)).alias("after"),
    )
    back = W.partitionBy(*keys).orderBy(F.desc(layout.PERIOD)).rowsBetween(W.unboundedPreceding, W.currentRow)
    on = W.partitionBy(*keys).orderBy(layout.PERIOD).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = counts.withColumns({"back": F.sum("before").over(back), "on": F.sum("after").over(on)})
    per_key = summed.groupBy(*keys).agg(
        F.max(F.when(F.col("back") >= rows, F.col(layout.PERIOD))).alias("first"),
        F.min(F.when(F.col("on") >= rows, F.col(layout.PERIOD))).alias("last"),
    )
    found = per_key.agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.count_if(F.col("first").isNull()).alias("no_first"), F.count_if(F.col("last").isNull()).alias("no_last"),
    ).head()
    return (None if found.no_first else found.first), (None if found.no_last else found.last)


def _span(
    spark: SparkSession, path: str, keys: Sequence[str], start: dt.datetime, end: dt.datetime, rows: int
) -> tuple[dt.datetime | None, dt.datetime | None]:
    first, last = halo(spark.read.parquet(path), keys, start, end, rows)
    midnight = lambda d: None if d is None else dt.datetime.combine(d, dt.time())
    after = None if last is None else midnight(last) + dt.timedelta(days=1)
    return midnight(first), after


def _replace(made: DataFrame, spark: SparkSession, path: str, start: dt.datetime, upto: dt.datetime | None) -> int:
    """Load what was made from ``start`` on; an open end is one day past the last day there is."""
    if upto is None:
        old = spark.read.parquet(path).agg(F.max(layout.PERIOD)).head()[0]
        new = made.agg(F.to_date(F.max(layout.TS))).head()[0]
        last = max(d for d in (old, new, start.date()) if d is not None)
        upto = dt.datetime.combine(last, dt.time()) + dt.timedelta(days=1)
    return layout.load_window(made.where(F.col(layout.TS) >= layout._at(start)), path, start, upto)


def refresh_solar_features(
    spark: SparkSession, path: str, solar: str, national: str, operators: str,
    start: dt.datetime, end: dt.datetime, keys: Sequence[str] = marts.ZONE, **options,
) -> int:
    """Bring the solar mart at ``path`` up to date with inputs that changed in ``[start, end)``.

    ``solar``, ``national`` and ``operators`` are paths of tables with daily partitions, as is
    the mart. Returns the rows written. The result equals a full build.
    """
    first, upto = _span(spark, path, keys, start, end, SOLAR_REACH)
    read = lambda at: layout.read_window(spark, at, first, upto)
    made = marts.solar_features(read(solar), read(national), read(operators), keys, **options)
    return _replace(made, spark, path, start, upto)


def refresh_household_features(
    spark: SparkSession, path: str, load: str, start: dt.datetime, end: dt.datetime, **options
) -> int:
    """Bring the household mart at ``path`` up to date with demand that changed in ``[start, end)``."""
    first, upto = _span(spark, path, ("building",), start, end, LOAD_REACH)
    made = marts.household_features(layout.read_window(spark, load, first, upto), **options)
    return _replace(made, spark, path, start, upto)
