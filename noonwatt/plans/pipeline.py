"""The daily build: raw tables in, audited staging tables and marts out.

Each model is a whole table, written once and read back by the models after it,
so raw data is scanned once whatever the number of models on top of it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from noonwatt.operators import quality
from noonwatt.plans import marts, staging
from noonwatt.sources.tables import replace_table, write_table

Built = dict[str, DataFrame]


def _models(spark: SparkSession) -> dict[str, tuple[Sequence[str], Callable[[Built], DataFrame]]]:
    """Model -> (what it reads, how it is built), in the order they are built."""

    def store(df: DataFrame) -> DataFrame:
        return write_table(df, spark, "part")

    return {
        "stg_price": (["price"], lambda t: staging.price(t["price"])),
        "stg_generation": (["public_power"], lambda t: staging.generation(t["public_power"])),
        "stg_day_ahead_forecast": (
            ["day_ahead_forecast"], lambda t: staging.operator_forecast(t["day_ahead_forecast"]),
        ),
        "stg_capacity": (["installed_power"], lambda t: staging.capacity(t["installed_power"])),
        "stg_weather": (["weather"], lambda t: staging.weather(t["weather"])),
        "stg_weather_national": (
            ["stg_weather"], lambda t: staging.weather_national(t["stg_weather"]),
        ),
        "stg_solar_output": (
            ["stg_generation", "stg_capacity"],
            lambda t: staging.solar_output(t["stg_generation"], t["stg_capacity"]),
        ),
        "mart_solar_features": (
            ["stg_solar_output", "stg_weather_national", "stg_day_ahead_forecast"],
            lambda t: marts.solar_features(
                t["stg_solar_output"], t["stg_weather_national"], t["stg_day_ahead_forecast"],
                store=store,
            ),
        ),
        "stg_household": (
            ["household"], lambda t: staging.household(t["household"], store=store),
        ),
        "stg_household_load": (
            ["stg_household"], lambda t: staging.household_load(t["stg_household"]),
        ),
        "mart_household_features": (
            ["stg_household_load"],
            lambda t: marts.household_features(t["stg_household_load"], store=store),
        ),
    }


def build(
    spark: SparkSession,
    raw: Built,
    target: str,
    audit: bool = True,
    partition_by: Sequence[str] = (),
    models: Sequence[str] | None = None,
) -> Built:
    """Build every model, or the named ones; a missing input or a failed audit stops the build.

    The audits read the written table, so offending rows can be looked at.
    """
    known = _models(spark)
    unknown = sorted(set(models or ()) - set(known))
    if unknown:
        raise ValueError(f"unknown models: {unknown}. Available: {sorted(known)}")
    tables = dict(raw)
    for name, (needs, make) in known.items():
        if models is not None and name not in models:
            continue
        missing = [n for n in needs if n not in tables]
        if missing:
            raise KeyError(f"{name} needs {missing}, which are neither given nor built before it")
        path = os.path.join(target, name)
        model = make(tables)
        columns = [c for c in partition_by if c in model.columns]
        replace_table(model, path, columns)
        tables[name] = spark.read.parquet(path)
        if audit and name in quality.AUDITS:
            quality.enforce(name, tables[name])
    return {name: df for name, df in tables.items() if name not in raw}
