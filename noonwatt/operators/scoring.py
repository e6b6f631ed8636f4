"""Forecast errors: per model, per source, per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.numbers import mae, ratio, rmse
from noonwatt.operators.reshape import latest_per_key

TS = "utc_timestamp"
ZONE = ("zone",)
BENCHMARK_LABEL = "TSO forecast"
OURS_LABEL = "our forecast"


def error_metrics(
    predictions: DataFrame,
    models: Sequence[str],
    keys: Sequence[str] = ZONE,
    benchmark: str = vocab.BENCHMARK,
) -> DataFrame:
    """Mean absolute error, root mean square error, bias and skill per model over
    daylight hours, the benchmark among them.

    The models of a row are turned into rows inside the scan, so all of them are
    scored in one aggregation.
    """
    scored = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(BENCHMARK_LABEL if m == benchmark else m).alias("model"),
                    (F.col(m) - F.col("actual")).alias("error"),
                )
                for m in [*models, benchmark]
            ]
        )
    )
    long = predictions.where("daylight").select(*keys, scored.alias("s")).select(*keys, "s.*")
    per_model = long.groupBy(*keys, "model").agg(
        mae("error").alias("mae"), rmse("error").alias("rmse"), F.avg("error").alias("bias")
    )
    bar = F.max(F.when(F.col("model") == BENCHMARK_LABEL, F.col("mae"))).over(W.partitionBy(*keys))
    return per_model.withColumn("skill_vs_tso", 1 - F.try_divide(F.col("mae"), bar))


def latest_issues(log: DataFrame, per_model: bool = False, keys: Sequence[str] = ZONE) -> DataFrame:
    """Newest forecast per hour; of one hour's models the newest wins unless
    ``per_model`` keeps them apart."""
    apart = [*keys, TS, *(["model_name"] if per_model else [])]
    return latest_per_key(log, apart, ["issued_at", "model_name"])


def score_log(
    log: DataFrame,
    solar: DataFrame,
    operators: DataFrame,
    latest_only: bool = True,
    per_model: bool = False,
    keys: Sequence[str] = ZONE,
) -> DataFrame:
    """Saved forecasts beside measured output and the operators' forecast.

    Joined to staging, not to the mart: scoring must not wait for weather.
    """
    on = [*keys, TS]
    measured = solar.where(F.col(vocab.TARGET).isNotNull()).select(
        *on, F.col(vocab.TARGET).alias("actual_capacity_factor"), "solar_ac_mw"
    )
    published = operators.select(*on, "solar_forecast_mw")
    issued = latest_issues(log, per_model, keys) if latest_only else log
    return (
        issued.join(measured, on)
        .join(published, on, "left")
        .select(
            *on,
            "target_date",
            "issued_at",
            "model_name",
            "predicted_capacity_factor",
            "ghi_mean_forecast",
            "actual_capacity_factor",
            ratio("solar_forecast_mw", "solar_ac_mw").alias("tso_capacity_factor"),
        )
    )


def _daylight(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("ghi_mean_forecast") > 0)


def score_summary(scored: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Error and hours of our forecast and of the benchmark, where it exists."""
    sources = F.explode(
        F.array(
            F.struct(
                F.lit(OURS_LABEL).alias("source"), F.col("predicted_capacity_factor").alias("cf")
            ),
            F.struct(
                F.lit(BENCHMARK_LABEL).alias("source"), F.col("tso_capacity_factor").alias("cf")
            ),
        )
    )
    long = _daylight(scored).select(*keys, "actual_capacity_factor", sources.alias("s"))
    known = long.where((F.col("s.source") == OURS_LABEL) | F.col("s.cf").isNotNull())
    return known.groupBy(*keys, F.col("s.source").alias("source")).agg(
        mae(F.col("s.cf") - F.col("actual_capacity_factor")).alias("mae"),
        F.count(F.lit(1)).alias("hours"),
    )


def score_by_day(scored: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    error = F.col("predicted_capacity_factor") - F.col("actual_capacity_factor")
    return _daylight(scored).groupBy(*keys, "target_date").agg(
        F.count(F.lit(1)).alias("hours"), mae(error).alias("mae"), F.avg(error).alias("bias")
    )


def score_report(scored: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Overall and per-day error in one table."""
    overall = score_summary(scored, keys).select(
        *keys, "source", F.lit(None).cast("date").alias("target_date"), "hours", "mae"
    )
    daily = score_by_day(scored, keys).select(
        *keys, F.lit(OURS_LABEL).alias("source"), "target_date", "hours", "mae"
    )
    return overall.unionByName(daily)
