"""Features and forecasts for a day that has not happened yet.

Weather and calendar columns come from the functions that build the training
mart, so a model is applied to what it was trained on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import calendar_columns, hour_spine, to_market
from noonwatt.operators.ordered import asof_backward, join_small, rolling_hours, value_at
from noonwatt.operators.quality import NAMED_KEYS, require_keys
from noonwatt.operators.reshape import complete_rows
from noonwatt.plans.marts import SOLAR_LAGS
from noonwatt.plans.staging import location_columns, national_columns

TS = "utc_timestamp"
ZONE = ("zone",)
LIVE_MEANS = {
    "capacity_factor_mean_7d": vocab.MEAN_7D_HOURS,
    "capacity_factor_mean_30d": vocab.MEAN_30D_HOURS,
}


def day_hours(zones: DataFrame, day: Column, keys: Sequence[str] = ZONE) -> DataFrame:
    """The 24 hours of the target day for each key."""
    planned = zones.select(*keys).distinct().withColumn("target_date", day)
    return planned.select(*keys, "target_date", F.explode(hour_spine("target_date")).alias(TS))


def weather_features(
    forecast: DataFrame, keys: Sequence[str] = ZONE, strict: bool = True
) -> DataFrame:
    """Forward forecasts collapsed to the training columns. There is one lead here,
    so the plain columns are read."""
    if strict:
        names = F.array(*[F.lit(n) for n in vocab.LOCATIONS])
        lacking = F.array_except(names, F.collect_set("location")).alias("lacking")
        short = forecast.groupBy(*keys).agg(lacking).where(F.size("lacking") > 0)
        missing = sorted({n for r in short.limit(NAMED_KEYS).collect() for n in r["lacking"]})
        if missing or forecast.isEmpty():
            raise KeyError(f"no weather for these locations: {missing or list(vocab.LOCATIONS)}")
    return forecast.groupBy(*keys, TS).agg(
        *location_columns("", F.avg), *national_columns("")
    )


def calendar_features(spine: DataFrame) -> DataFrame:
    return spine.withColumns(calendar_columns(to_market(TS)))


def history_features(
    spine: DataFrame, history: DataFrame, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Lags by time, and the rolling means as they stood 48 hours before."""
    observed = history.select(*keys, TS, vocab.TARGET)
    lagged = value_at(spine, observed, keys, TS, vocab.TARGET, SOLAR_LAGS)
    rolled = rolling_hours(observed, keys, TS, vocab.TARGET, LIVE_MEANS)
    return asof_backward(
        lagged, rolled, keys, TS, list(LIVE_MEANS), offset_hours=vocab.GATE_SAFE_OFFSET
    )


def live_features(
    history: DataFrame,
    forecast: DataFrame,
    day: Column,
    keys: Sequence[str] = ZONE,
    strict: bool = True,
) -> DataFrame:
    """One row per key and hour of the target day with every model input and the
    last known capacity."""
    hours = day_hours(history, day, keys)
    weather = weather_features(forecast, keys, strict)
    spine = hours.join(weather, [*keys, TS], "left")
    if strict:
        covered = spine.where(F.col("ghi_mean").isNotNull())
        require_keys(history, covered, keys, "no weather forecast for any hour of the target day")
    built = history_features(calendar_features(spine), history, keys)
    latest = history.groupBy(*keys).agg(F.max_by("solar_ac_mw", TS).alias("solar_ac_mw"))
    return join_small(built, latest, keys)


def predict_day(
    features: DataFrame,
    predict,
    now: Column,
    keys: Sequence[str] = ZONE,
) -> DataFrame:
    """Forecast the target day with ``predict``, a function that adds the column
    ``predicted`` to rows with a complete feature set."""
    usable = complete_rows(features, vocab.FEATURES)
    predicted = predict(usable)
    return predicted.select(
        *keys,
        TS,
        to_market(TS).alias("local_datetime"),
        F.col("predicted").alias("predicted_capacity_factor"),
        (F.col("predicted") * F.col("solar_ac_mw")).alias("predicted_mw"),
        F.col("ghi_mean").alias("ghi_mean_forecast"),
        now.alias("issued_at"),
        "target_date",
    )


def require_usable(prediction: DataFrame, history: DataFrame, keys: Sequence[str] = ZONE) -> None:
    """Stop where no hour of a key could be forecast; say which key, up to when its history
    reaches and what the lags need: the last hour before the longest safe offset."""
    wanted, there = history.select(*keys).distinct().alias("e"), prediction.select(*keys).distinct().alias("f")
    absent = wanted.join(there, [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left_anti")
    seen = history.groupBy(*keys).agg(F.max(F.when(F.col(vocab.TARGET).isNotNull(), F.col(TS))).alias("last"))
    rows = join_small(seen, absent, keys).orderBy(*keys).limit(NAMED_KEYS).collect()
    if rows:
        told = ", ".join(f"{'/'.join(str(r[k]) for k in keys)}: {r['last']}" for r in rows)
        raise ValueError(
            f"no hour of the target day has all inputs; history ends at ({told}), and the lags "
            f"need every hour up to {vocab.GATE_SAFE_OFFSET} hours before the target"
        )


def hours_without_inputs(features: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """(keys, target_date, hours, missing_weather, missing_history): per key, the hours of the
    target day that cannot be forecast, and why. Keys with all hours complete have no row."""
    weather = F.exists(F.array(*[F.col(c).isNull() for c in vocab.WEATHER_FEATURES]), lambda x: x)
    past = F.exists(F.array(*[F.col(c).isNull() for c in vocab.HISTORY_FEATURES]), lambda x: x)
    counted = features.groupBy(*keys, "target_date").agg(
        F.count_if(weather | past).alias("hours"),
        F.count_if(weather).alias("missing_weather"),
        F.count_if(past).alias("missing_history"),
    )
    return counted.where(F.col("hours") > 0)
