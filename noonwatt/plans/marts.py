"""Feature marts: every column is known at the gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import calendar_columns, gate, hours_between, is_weekend
from noonwatt.functions.numbers import ratio
from noonwatt.operators.ordered import trailing_rows
from noonwatt.operators.reshape import complete_rows, drop_columns
from noonwatt.sources import layout

ZONE = ("zone",)
TS = "utc_timestamp"

# Positional look-backs: (rows back) and (first, last rows back of the frame).
SOLAR_LAGS = {f"capacity_factor_lag_{h}h": h for h in vocab.LAG_HOURS}
SOLAR_MEANS = {
    "capacity_factor_mean_7d": (vocab.MEAN_7D_HOURS + 47, vocab.GATE_SAFE_OFFSET),
    "capacity_factor_mean_30d": (vocab.MEAN_30D_HOURS + 47, vocab.GATE_SAFE_OFFSET),
}
LOAD_LAGS = {"consumption_lag_48h": 48, "consumption_lag_168h": 168}
LOAD_MEANS = {"consumption_mean_7d": (vocab.MEAN_7D_HOURS + 47, vocab.GATE_SAFE_OFFSET)}


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    lags: dict[str, int],
    means: dict[str, tuple[int, int]],
    **sizes: int,
) -> DataFrame:
    return trailing_rows(
        df,
        keys,
        TS,
        {name: (value, n) for name, n in lags.items()},
        {name: (value, first, last) for name, (first, last) in means.items()},
        **sizes,
    )


def solar_features(
    solar: DataFrame,
    national: DataFrame,
    operators: DataFrame,
    keys: Sequence[str] = ZONE,
    gate_hour: int = vocab.GATE_HOUR,
    store: Callable[[DataFrame], DataFrame] | None = None,
    buckets: Sequence[str] = (),
    **sizes: int,
) -> DataFrame:
    """Day-ahead solar features: hours with weather, the gate, the calendar, the
    lagged target, and the operators' forecast as benchmark.

    Placing the rows reads the joined hours twice; ``store`` may write them first.
    ``buckets`` names further columns that all three tables derive from the hour and are
    bucketed by: with them in the join keys nothing is shuffled to join.
    """
    on = [*keys, *buckets, TS]
    published = operators.select(*on, F.col("solar_forecast_mw").alias("tso_solar_forecast_mw"))
    joined = (
        solar.select(*on, "local_datetime", "solar_mw", "solar_ac_mw", vocab.TARGET)
        .join(drop_columns(national, "locations_reporting"), on, "inner")
        .join(published, on, "left")
    )
    joined = store(joined) if store else joined
    historic = with_history(joined, keys, vocab.TARGET, SOLAR_LAGS, SOLAR_MEANS, **sizes)
    gated = historic.withColumn("gate_utc", gate("local_datetime", hour=gate_hour))
    return gated.select(
        *keys,
        TS,
        "local_datetime",
        "gate_utc",
        hours_between("gate_utc", TS).alias("horizon_hours"),
        "solar_mw",
        "solar_ac_mw",
        vocab.TARGET,
        *[c.alias(n) for n, c in calendar_columns("local_datetime").items()],
        *vocab.WEATHER_FEATURES,
        *vocab.HISTORY_FEATURES,
        "tso_solar_forecast_mw",
        ratio("tso_solar_forecast_mw", "solar_ac_mw").alias(vocab.BENCHMARK),
    )


def household_features(
    load: DataFrame, store: Callable[[DataFrame], DataFrame] | None = None, **sizes: int
) -> DataFrame:
    """Household demand with calendar and gate-safe lags.

    Rows without plausible demand go first, so positional lags step over gaps.
    """
    usable = load.where(F.col("consumption_kwh") >= 0)
    usable = store(usable) if store else usable
    historic = with_history(usable, ("building",), "consumption_kwh", LOAD_LAGS, LOAD_MEANS, **sizes)
    return historic.select(
        TS,
        "local_datetime",
        "building",
        "building_type",
        "has_pv",
        "consumption_kwh",
        "grid_import_kwh",
        "pv_kwh",
        "heat_pump_kwh",
        "ev_kwh",
        *[c.alias(n) for n, c in calendar_columns("local_datetime").items()],
        is_weekend("local_datetime").alias("is_weekend"),
        *LOAD_LAGS,
        *LOAD_MEANS,
    )


def model_inputs(mart: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The allow-listed inputs, in order; bookkeeping and benchmark are refused."""
    leaked = sorted(set(vocab.FEATURES) & set(vocab.NEVER_FEATURES))
    if leaked:
        raise ValueError(f"not allowed as model inputs: {leaked}")
    missing = sorted(set(vocab.FEATURES) - set(mart.columns))
    if missing:
        raise KeyError(f"mart is missing features: {missing}")
    return mart.select(*extra, *vocab.FEATURES)


def modelling_rows(mart: DataFrame) -> DataFrame:
    """Rows with a target and a complete feature set."""
    return complete_rows(mart, [vocab.TARGET, *vocab.FEATURES])


def daylight(df: DataFrame, column: str = "ghi_max") -> DataFrame:
    """Hours with forecast irradiance anywhere; night is right for free."""
    return df.where(F.col(column) > 0)


def recent_generation(solar: DataFrame, now, days: int = 40) -> DataFrame:
    """Recent measured output straight from staging.

    Forty days by default: the 30-day mean reaches back 32. Of a table with daily partitions
    only those days are read.
    """
    since = now - F.expr(f"INTERVAL '{int(days)}' DAY")
    if layout.PERIOD in solar.columns:
        solar = layout.in_window(solar, since)
    return solar.where((F.col(TS) >= since) & F.col(vocab.TARGET).isNotNull()).select(
        *[c for c in solar.columns if c in ("zone",)], TS, vocab.TARGET, "solar_ac_mw"
    )
