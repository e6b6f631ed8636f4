"""Where queries and their checking SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonwatt.session import configure
from workload.ctes import CTES, sql as with_ctes
from workload.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Name -> (function of the tables, digits that its columns are rounded to).
MADE: dict[str, tuple[Callable[[Tables], DataFrame], dict[str, int]]] = {}


def _digits(spec: str | None) -> dict[str, int]:
    """``"a b:6"`` -> {"a": 9, "b": 6}."""
    found = {}
    for item in (spec or "").split():
        name, _, digits = item.partition(":")
        found[name] = int(digits or 9)
    return found


def register(
    name: str, body: str | None = None, rounded: str | None = None, **ctes: str
) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``body`` is the SELECT for DuckDB. ``rounded`` lists the double columns that
    both sides round, since the two engines add in different orders.
    """
    digits = _digits(rounded)

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        MADE[name] = fn, digits
        QUERIES[name] = over(name)
        if body is not None:
            text = CTES[body] if body in CTES else body
            if digits:
                replaced = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in digits.items())
                text = f"SELECT * REPLACE ({replaced}) FROM ({text})"
            ORACLE[name] = with_ctes(text, **ctes)
        return fn

    return add


def over(name: str, tables: type[Tables] = Tables) -> Callable[[SparkSession, str], DataFrame]:
    """The query of a registered function over ``tables``."""
    fn, digits = MADE[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(tables(configure(spark), sf_dir))
        return df.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else df

    run.__name__, run.__doc__ = name, fn.__doc__
    return run
