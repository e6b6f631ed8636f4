"""Summaries of series: shapes, spreads, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.calendar import hours_between, market_date, to_market
from noonwatt.operators.ordered import join_small
from noonwatt.operators.quantiles import exact_quantiles
from noonwatt.operators.reshape import spread

TS = "utc_timestamp"
ZONE = ("zone",)


def _hour() -> Column:
    return F.hour(to_market(TS)).cast("bigint")


def _rows() -> Column:
    return F.count(F.lit(1))


# --- prices -------------------------------------------------------------------------


def daily_spread(prices: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Dearest less cheapest hour per local day, whole 24-hour days only."""
    daily = prices.groupBy(*keys, market_date(TS).alias("day")).agg(
        (F.max("price_eur_mwh") - F.min("price_eur_mwh")).alias("price_spread_eur_mwh"),
        _rows().alias("hours"),
    )
    return daily.where(F.col("hours") == vocab.HOURS_PER_DAY).drop("hours")


def annualise(daily: DataFrame, keys: Sequence[str], energy_mwh: str = "energy_mwh") -> DataFrame:
    """Observed daily revenue scaled to a year, with the cycles it cost."""
    per_day = F.avg("energy_cycled_mwh") / F.max(energy_mwh)
    return daily.groupBy(*keys).agg(
        _rows().alias("days"),
        F.sum("revenue_eur").alias("total_eur"),
        F.avg("revenue_eur").alias("mean_daily_eur"),
        (F.avg("revenue_eur") * vocab.DAYS_PER_YEAR).alias("annual_eur"),
        per_day.alias("cycles_per_day"),
        (per_day * vocab.DAYS_PER_YEAR).alias("cycles_per_year"),
    )


def price_shape(prices: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Mean price by local hour of day."""
    return prices.groupBy(*keys, _hour().alias("hour_of_day")).agg(
        F.avg("price_eur_mwh").alias("mean_eur_mwh")
    )


def shape_range(shape: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """How far the dearest hour of the mean day lies above the cheapest."""
    return shape.groupBy(*keys).agg(
        (F.max("mean_eur_mwh") - F.min("mean_eur_mwh")).alias("shape_range_eur_mwh")
    )


def negative_share(prices: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    negative = F.col("price_eur_mwh") < 0
    return prices.groupBy(*keys).agg(
        F.count_if(negative).alias("negative_hours"),
        F.count("price_eur_mwh").alias("hours"),
        F.avg(negative.cast("double")).alias("negative_share"),
    )


# --- output ---------------------------------------------------------------------------


def month_by_hour(df: DataFrame, value: str, keys: Sequence[str] = ZONE) -> DataFrame:
    """Mean by local month (rows) and hour of day (columns h00 to h23)."""
    hours = {h: f"h{h:02d}" for h in range(vocab.HOURS_PER_DAY)}
    placed = df.withColumns({"__hour": _hour(), "month_of_year": F.month(to_market(TS)).cast("bigint")})
    return placed.groupBy(*keys, "month_of_year").agg(*spread("__hour", value, hours, F.avg))


def yearly(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Mean capacity, generation and capacity factor per local year."""
    return df.groupBy(*keys, F.year("local_datetime").cast("bigint").alias("year")).agg(
        (F.avg("solar_ac_mw") / 1000).alias("capacity_gw"),
        (F.avg("solar_mw") / 1000).alias("generation_gw"),
        F.avg(vocab.TARGET).alias("capacity_factor"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    )
    long = df.select(pairs.alias("p")).select("p.*")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quartiles, "column", "left")


def correlation(df: DataFrame, x: str, y: str, keys: Sequence[str] = ZONE) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(x, y).alias("correlation"), _rows().alias("hours"))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed, a single value sits mid-range."""
    place = F.floor((value - low) * bins / (high - low))
    return F.when(high > low, F.least(F.lit(bins - 1), place)).otherwise(F.lit(bins // 2)).cast("bigint")


def histogram(
    df: DataFrame, value: str, bins: int, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Rows per equal-width bin between the least and greatest value."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    ends = known.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    placed = join_small(known, ends, keys).withColumn(
        "bin", _bin(F.col(value), F.col("__low"), F.col("__high"), bins)
    )
    return placed.groupBy(*keys, "bin").agg(_rows().alias("hours"))


def density(
    df: DataFrame, x: str, y: str, bins: int, keys: Sequence[str] = ZONE
) -> DataFrame:
    """Rows per cell of an equal-width grid over two columns."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ends = known.groupBy(*keys).agg(
        F.min(x).alias("__xl"), F.max(x).alias("__xh"),
        F.min(y).alias("__yl"), F.max(y).alias("__yh"),
    )
    placed = join_small(known, ends, keys).withColumns(
        {
            "x_bin": _bin(F.col(x), F.col("__xl"), F.col("__xh"), bins),
            "y_bin": _bin(F.col(y), F.col("__yl"), F.col("__yh"), bins),
        }
    )
    return placed.groupBy(*keys, "x_bin", "y_bin").agg(_rows().alias("hours"))


def error_by_hour(mart: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Mean error of the benchmark and of 48-hour persistence by hour of day, on
    the same daylight rows."""
    lag = "capacity_factor_lag_48h"
    both = mart.where(
        (F.col("ghi_max") > 0) & F.col(vocab.BENCHMARK).isNotNull() & F.col(lag).isNotNull()
    )
    return both.groupBy(*keys, "hour_of_day").agg(
        F.avg(F.abs(F.col(vocab.BENCHMARK) - F.col(vocab.TARGET))).alias("tso_error"),
        F.avg(F.abs(F.col(lag) - F.col(vocab.TARGET))).alias("lag_error"),
        _rows().alias("hours"),
    )


def daily_peak(df: DataFrame, value: str = vocab.TARGET, keys: Sequence[str] = ZONE) -> DataFrame:
    """Highest value per local day."""
    return df.groupBy(*keys, F.to_date("local_datetime").alias("day")).agg(
        F.max(value).alias("peak")
    )


def peak_ratio(peaks: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Best day's peak over the worst day's."""
    return peaks.groupBy(*keys).agg(
        _rows().alias("days"),
        F.max("peak").alias("best"),
        F.min("peak").alias("worst"),
        F.try_divide(F.max("peak"), F.min("peak")).alias("ratio"),
    )


def night_and_midday(gen: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Mean output at 02:00 and at 11:00 UTC."""
    hour = F.hour(TS)
    return gen.groupBy(*keys).agg(
        F.avg(F.when(hour == 2, F.col("solar_mw"))).alias("night_mw"),
        F.avg(F.when(hour == 11, F.col("solar_mw"))).alias("midday_mw"),
    )


# --- meters and mart checks ---------------------------------------------------------------


def meter_summary(metered: DataFrame) -> DataFrame:
    """Outcome of the meter conversion per building type."""
    return metered.groupBy("building_type").agg(
        _rows().alias("rows_total"),
        F.count_if(F.col("energy_kwh").isNotNull()).alias("with_energy"),
        F.count_if("is_implausible").alias("flagged"),
        F.max("meter_kwh").alias("max_cumulative"),
        F.max(F.when(~F.col("is_implausible"), F.col("energy_kwh"))).alias("max_hourly_kept"),
        F.max(F.when(F.col("is_implausible"), F.col("energy_kwh"))).alias("max_hourly_flagged"),
        F.min("energy_kwh").alias("min_hourly"),
    )


def horizon_histogram(mart: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Rows per horizon, and in how many of them the local month is October."""
    october = F.month("local_datetime") == 10
    return mart.groupBy(*keys, "horizon_hours").agg(
        _rows().alias("n"), F.count_if(october).alias("in_october")
    )


def bounds(mart: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    return mart.groupBy(*keys).agg(
        F.min(vocab.TARGET).alias("lo"),
        F.max(vocab.TARGET).alias("hi"),
        F.count_if(F.col(vocab.TARGET).isNull()).alias("missing"),
    )


def trend_removed(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """Growth of capacity from first to last year against the drift of the
    yearly capacity factor."""
    years = yearly(df, keys)
    growth = F.max_by("capacity_gw", "year") / F.min_by("capacity_gw", "year") - 1
    drift = F.max("capacity_factor") / F.min("capacity_factor") - 1
    return years.groupBy(*keys).agg(
        growth.alias("capacity_growth"), drift.alias("capacity_factor_drift")
    )


def regional_spread(mart: DataFrame, above: float = 100.0, keys: Sequence[str] = ZONE) -> DataFrame:
    return mart.where(F.col("ghi_max") > above).groupBy(*keys).agg(
        F.avg("ghi_spread").alias("mean_spread"), F.max("ghi_spread").alias("max_spread")
    )


def interval_mix(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    return df.groupBy(*keys, "source_intervals").agg(_rows().alias("n"))


def latest_capacity(capacity: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """The newest month that reports both solar ratings."""
    both = capacity.where(F.col("solar_ac_mw").isNotNull() & F.col("solar_dc_mw").isNotNull())
    return both.groupBy(*keys).agg(
        F.max("month").alias("month"),
        F.max_by("solar_ac_mw", "month").alias("solar_ac_mw"),
        F.max_by("solar_dc_mw", "month").alias("solar_dc_mw"),
    )


def series_era(df: DataFrame, keys: Sequence[str] = ZONE) -> DataFrame:
    """First year, days spanned and rows of a series."""
    return df.groupBy(*keys).agg(
        _rows().alias("n"),
        F.year(F.min(TS)).cast("bigint").alias("first_year"),
        F.floor(hours_between(F.min(TS), F.max(TS)) / 24).cast("bigint").alias("span_days"),
    )
