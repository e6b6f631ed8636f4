"""Long-to-wide reshaping and completeness rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import hour_start


def spread(
    category: str,
    value: str,
    columns: dict[str, str],
    aggregate: Callable[[Column], Column],
) -> list[Column]:
    """One conditional aggregate per category, for use inside a single ``agg``.

    The categories are named up front, so no pass over the data is spent on
    finding them, and partial aggregation happens before the shuffle.
    """
    return [
        aggregate(F.when(F.col(category) == name, F.col(value))).alias(column)
        for name, column in columns.items()
    ]


def to_hours(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    intervals: Column,
    order: str = "utc_timestamp",
    complete: Sequence[int] = vocab.COMPLETE_HOUR_INTERVALS,
) -> DataFrame:
    """Resample to whole hours; keep an hour only if it is built from one value
    or from all four of its quarters."""
    return (
        df.groupBy(*keys, hour_start(order).alias(order))
        .agg(*aggregates, intervals.cast("bigint").alias("source_intervals"))
        .where(F.col("source_intervals").isin(*complete))
    )


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Every column but the named ones; an unknown name is an error."""
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise KeyError(f"no such columns: {unknown}")
    return df.drop(*names)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of the columns is NULL.

    One predicate per column: each can be pushed to the scan, where a single
    count of non-null columns could not.
    """
    return df.where(reduce(and_, [F.col(name).isNotNull() for name in columns]))


def time_slice(
    df: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    upto: Column | None = None,
    order: str = "utc_timestamp",
) -> DataFrame:
    """Half-open ``[start, end)`` or closed ``<= upto`` slice, as plain range
    predicates the Parquet scan can use."""
    at = F.col(order)
    for wanted, predicate in (
        (start, lambda: at >= start),
        (end, lambda: at < end),
        (upto, lambda: at <= upto),
    ):
        if wanted is not None:
            df = df.where(predicate())
    return df


def top_hours(
    df: DataFrame, keys: Sequence[str], value: str, n: int = 3, dearest: bool = False,
    order: str = "utc_timestamp",
) -> DataFrame:
    """The ``n`` lowest (or highest) rows per key; earlier rows win ties."""
    from pyspark.sql import Window as W

    by = F.col(value).desc() if dearest else F.col(value).asc()
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(by, order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row with the greatest ``by`` per key, by aggregation, without a sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*by)).alias("__row"))
    return best.select("__row.*")


def first_at_peak(
    df: DataFrame, keys: Sequence[str], value: str, order: str = "utc_timestamp"
) -> DataFrame:
    """The row where ``value`` peaks, the earliest one on ties."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(-F.col(value).alias("v"), F.col(order))
    peaked = df.where(F.col(value).isNotNull())
    return peaked.groupBy(*keys).agg(F.min_by(row, rank).alias("__row")).select("__row.*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
