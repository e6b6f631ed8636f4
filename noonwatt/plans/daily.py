"""The daily run as one call: forecast tomorrow, log it, plan every site."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import target_day
from noonwatt.plans import dayplan, live
from noonwatt.plans.boosting import Boosted, Forecaster, boosted_per_key, predict_per_key
from noonwatt.sources.tables import save_predictions, write_table

TS = "utc_timestamp"
ZONE = ("zone",)


@dataclass(frozen=True)
class DailyRun:
    """``prediction`` per hour, ``plan`` per site and day as arrays, ``advice`` as lines."""

    prediction: DataFrame
    plan: DataFrame
    advice: DataFrame


def run(
    frame: DataFrame,
    history: DataFrame,
    weather: DataFrame,
    prices: DataFrame,
    sites: DataFrame,
    batteries: DataFrame,
    now: Column,
    log_path: str | None,
    load: DataFrame | None = None,
    forecaster: Forecaster | None = None,
    boosted: Boosted = Boosted(),
    model_name: str = "gradient_boosting",
    keys: Sequence[str] = ZONE,
    flat_mw: float = vocab.FLAT_LOAD_MW,
    day: Column | None = None,
    save: bool = True,
) -> DailyRun:
    """Train boosted trees, or ``forecaster``, on ``frame``, forecast ``day`` (by default the one after ``now``), append it to the
    log at ``log_path`` unless ``save`` is off, and plan all sites with the prices of that day.

    A key without weather, with history that ends too early or without a day of 24 priced hours
    raises and is named.
    """
    spark = frame.sparkSession

    def predict(rows: DataFrame) -> DataFrame:
        if forecaster is None:
            made = boosted_per_key(frame, rows, "predicted", boosted, keys)
        else:
            made = predict_per_key(frame, rows, {"predicted": forecaster}, keys)
        return rows.join(made, [*keys, TS])

    features = live.live_features(history, weather, target_day(now) if day is None else day, keys)
    made = live.predict_day(features, predict, now, keys)
    prediction = write_table(made, spark, "prediction")
    live.require_usable(prediction, history, keys)
    if save:
        save_predictions(prediction, log_path, model_name)
    plan = dayplan.planned_days(prediction, prices, sites, batteries, load, keys, flat_mw=flat_mw)
    plan = write_table(plan, spark, "plan")
    return DailyRun(prediction, plan, dayplan.advice(plan, keys))
