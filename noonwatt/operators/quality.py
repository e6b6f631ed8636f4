"""Audits: each returns the offending rows; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import hours, hours_between
from noonwatt.operators.ordered import gap_minutes
from noonwatt.operators.reshape import union_all

TS = "utc_timestamp"
ZONE = ("zone",)


def duplicates(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    counted = df.groupBy(*keys, TS).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.where(F.col("occurrences") > 1)


def broken_grid(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    steps = gap_minutes(df.select(*keys, TS), keys)
    return steps.where(F.col("step_minutes") != 60)


def partial_hours(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    bad = ~F.col("source_intervals").isin(*vocab.COMPLETE_HOUR_INTERVALS)
    return df.where(bad).select(*keys, TS, "source_intervals")


def gate_not_before_target(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    late = df.where(F.col("gate_utc") >= F.col(TS))
    return late.select(*keys, TS, "gate_utc", "horizon_hours")


def horizon_out_of_range(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    low, high = vocab.HORIZON_HOURS
    bad = df.where(~F.col("horizon_hours").between(low, high))
    return bad.select(*keys, TS, "horizon_hours")


def unphysical_output(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    bad = df.where(~F.col(vocab.TARGET).between(0, 1))
    return bad.select(*keys, TS, vocab.TARGET)


_GRID = (duplicates, broken_grid)
_RESAMPLED = (*_GRID, partial_hours)
#: Which audits guard which model.
AUDITS: dict[str, Sequence[Callable[..., DataFrame]]] = {
    "stg_price": _RESAMPLED,
    "stg_generation": _RESAMPLED,
    "stg_day_ahead_forecast": _RESAMPLED,
    "stg_solar_output": _GRID,
    "stg_weather_national": _GRID,
    "mart_solar_features": (
        *_GRID, gate_not_before_target, horizon_out_of_range, unphysical_output,
    ),
}


def violations(model: str, df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Violations per audit attached to a model: (model, audit, violations)."""
    return union_all(
        [
            audit(df, keys)
            .agg(F.count(F.lit(1)).alias("violations"))
            .select(F.lit(model).alias("model"), F.lit(audit.__name__).alias("audit"), "violations")
            for audit in AUDITS[model]
        ]
    )


def enforce(model: str, df: DataFrame, keys: Sequence[str] = ZONE) -> None:
    """Run a model's audits and fail on any violation."""
    broken = violations(model, df, keys).where(F.col("violations") > 0).collect()
    if broken:
        listed = ", ".join(f"{r['audit']}: {r['violations']}" for r in broken)
        raise ValueError(f"{model} failed its audits ({listed})")


# --- checks across models -------------------------------------------------------


def coverage(models: dict[str, DataFrame]) -> DataFrame:
    """Rows, first and last hour per model."""
    return union_all(
        [
            df.agg(
                F.count(F.lit(1)).alias("n"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")
            ).select(F.lit(name).alias("model"), "n", "first_ts", "last_ts")
            for name, df in models.items()
        ]
    )


def span_agreement(models: dict[str, DataFrame]) -> DataFrame:
    """How far models that share one grid differ in length, and how long they overlap."""
    c = coverage(models)
    return c.agg(
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
        (F.max("n") - F.min("n")).alias("row_difference"),
        F.floor(hours_between(F.max("first_ts"), F.min("last_ts")) / 24)
        .cast("bigint").alias("overlap_days"),
    )


def thin_hours(long: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Hours that not every location reports for."""
    per_hour = long.groupBy(*keys, TS).agg(F.count(F.lit(1)).alias("locations"))
    return per_hour.where(F.col("locations") != len(vocab.LOCATIONS))


def uncovered_hours(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Rows of ``left`` inside the time range of ``right`` that ``right`` lacks."""
    from noonwatt.operators.ordered import join_small

    bounds = right.groupBy(*keys).agg(F.min(TS).alias("__first"), F.max(TS).alias("__last"))
    inside = join_small(left, bounds, keys).where(
        F.col(TS).between(F.col("__first"), F.col("__last"))
    )
    return inside.join(right.select(*keys, TS), [*keys, TS], "left_anti").drop("__first", "__last")


def lag_mismatches(
    df: DataFrame, lagged: str, value: str, lag_hours: int, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Rows whose stored lag differs from the value that many hours earlier."""
    paired = earlier_value(df, lagged, value, lag_hours, keys)
    return paired.where(F.abs(F.col(lagged) - F.col("actual")) > 1e-9)


def earlier_value(
    df: DataFrame, lagged: str, value: str, lag_hours: int, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Self-join on the hour shifted by the lag: a plain equi-join."""
    shifted = df.select(
        *keys, (F.col(TS) + hours(lag_hours)).alias(TS), F.col(value).alias("actual")
    )
    return df.select(*keys, TS, lagged).join(shifted, [*keys, TS])


def missing_names(expected: Sequence[str], found: DataFrame, column: str) -> DataFrame:
    """Expected names that never occur in ``column``."""
    names = F.explode(F.array(*[F.lit(n) for n in expected])).alias(column)
    wanted = found.sparkSession.range(1).select(names)
    return wanted.join(found.select(column).distinct(), column, "left_anti")


#: Keys that an error names before it only counts them.
NAMED_KEYS = 20


def require_keys(expected: DataFrame, found: DataFrame, keys: Sequence[str], message: str) -> None:
    """Stop where a key of ``expected`` has no row in ``found``, and name it: one key that lacks
    its data must not be missing silently among the others."""
    wanted, there = expected.select(*keys).distinct().alias("e"), found.select(*keys).distinct().alias("f")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    absent = wanted.join(there, same, "left_anti")
    rows = absent.orderBy(*keys).limit(NAMED_KEYS + 1).collect()
    if rows:
        names = ["/".join(str(v) for v in r) for r in rows[:NAMED_KEYS]]
        more = " and more" if len(rows) > NAMED_KEYS else ""
        raise ValueError(f"{message} (for {', '.join(names)}{more})")


def require_columns(df: DataFrame, required: Sequence[str], what: str = "frame") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise KeyError(f"{what} is missing columns: {missing}")


def join_loss(mart: DataFrame, weather: DataFrame, lost: DataFrame, slack: int = 48) -> DataFrame:
    """Mart rows against weather rows, and generation hours lost in the join."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
        for name, df in (("mart", mart), ("weather", weather), ("lost", lost))
    ]
    counted = union_all(parts).agg(
        *[
            F.max(F.when(F.col("side") == side, F.col("n"))).alias(name)
            for side, name in (
                ("mart", "mart_rows"), ("weather", "weather_rows"), ("lost", "unmatched"),
            )
        ]
    )
    covered = F.col("mart_rows") >= F.col("weather_rows") - slack
    return counted.withColumn("covered", covered)
