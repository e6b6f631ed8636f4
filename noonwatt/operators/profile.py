"""Household load profiles, for every building at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import hour_of_week, hour_spine, to_market
from noonwatt.operators.ordered import join_small

TS, BUILDING, LOAD = "utc_timestamp", "building", "consumption_kwh"


def building_rows(mart: DataFrame, building: str = vocab.DEFAULT_BUILDING) -> DataFrame:
    return mart.where(F.col(BUILDING) == building)


def _keyed(load: DataFrame) -> DataFrame:
    known = load.where(F.col(LOAD).isNotNull())
    return known.withColumn("hour_of_week", hour_of_week("local_datetime"))


def fit_profiles(load: DataFrame) -> DataFrame:
    """Mean demand per building and hour of the week.

    Level and hours observed come from the same 168 cells, so the load is
    aggregated once.
    """
    cells = (
        _keyed(load)
        .groupBy(BUILDING, "hour_of_week")
        .agg(F.sum(LOAD).alias("__sum"), F.count(LOAD).alias("cell_hours"))
    )
    level = cells.groupBy(BUILDING).agg(
        (F.sum("__sum") / F.sum("cell_hours")).alias("overall_mean_kwh"),
        F.sum("cell_hours").alias("hours_observed"),
    )
    return cells.join(level, BUILDING).select(
        BUILDING,
        "hour_of_week",
        (F.col("__sum") / F.col("cell_hours")).alias("mean_kwh"),
        "cell_hours",
        "overall_mean_kwh",
        "hours_observed",
    )


def profile_level(profiles: DataFrame) -> DataFrame:
    """One row per building: overall mean, hours observed, and the profile's daily energy."""
    return profiles.groupBy(BUILDING).agg(
        F.max("overall_mean_kwh").alias("overall_mean_kwh"),
        F.max("hours_observed").alias("hours_observed"),
        (F.avg("mean_kwh") * vocab.HOURS_PER_DAY).alias("daily_kwh"),
    )


def _weeks(profiles: DataFrame) -> DataFrame:
    """One row per building: its mean, and the means of its hours of the week as a map."""
    return profiles.groupBy(BUILDING).agg(
        F.max("overall_mean_kwh").alias("overall_mean_kwh"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("hour_of_week").isNotNull(), F.struct("hour_of_week", "mean_kwh")))
        ).alias("__week"),
    )


def _expected():
    return F.coalesce(F.try_element_at("__week", F.col("hour_of_week")), "overall_mean_kwh")


def profile_for_days(profiles: DataFrame, days: DataFrame) -> DataFrame:
    """The 24 values each profile gives for each local ``day`` in ``days``.

    Days with a building column are planned for that building; without, for all.
    An hour of the week never observed takes the building's mean.
    """
    if BUILDING not in days.columns:
        raise KeyError("days must name the building they are planned for")
    hours = days.withColumn(TS, F.explode(hour_spine("day"))).withColumn(
        "hour_of_week", hour_of_week(to_market(TS))
    )
    found = join_small(hours, _weeks(profiles), [BUILDING])
    return found.select(*days.columns, TS, _expected().alias("load_kwh"))


def score_profiles(load: DataFrame, profiles: DataFrame) -> DataFrame:
    """Error of the profile against a flat load at the building's mean."""
    rows = join_small(_keyed(load), _weeks(profiles), [BUILDING])
    error = _expected() - F.col(LOAD)
    scored = rows.groupBy(BUILDING).agg(
        F.avg(F.abs(error)).alias("profile_mae_kwh"),
        F.avg(F.abs(F.col("overall_mean_kwh") - F.col(LOAD))).alias("flat_mae_kwh"),
        F.count(F.lit(1)).alias("hours"),
    )
    return scored.withColumn(
        "improvement", 1 - F.try_divide(F.col("profile_mae_kwh"), F.col("flat_mae_kwh"))
    )
