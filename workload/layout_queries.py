"""Windowed, bucketed and sketched tables: the same rows as the plain models give."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.operators import scoring, sketches
from noonwatt.plans import incremental, marts
from noonwatt.session import shared_folder
from noonwatt.sources import catalog, layout
from workload.explore_queries import COVERAGE, _hourly_models
from workload.registry import register
from workload.staging_queries import MART

TS = "utc_timestamp"
#: Before and after everything, and the stretch that arrives late.
FIRST, LAST = dt.datetime(2000, 1, 1), dt.datetime(2030, 1, 1)
FROM, UPTO = dt.datetime(2024, 1, 14, 6), dt.datetime(2024, 1, 16, 18)


def _table(t, name):
    return os.path.join(shared_folder(t.spark), name)


def _stretch(df):
    return df.where((F.col(TS) >= F.lit(str(FROM)).cast("timestamp_ntz")) & (F.col(TS) < F.lit(str(UPTO)).cast("timestamp_ntz")))


def _amiss(df, *columns):
    """``df`` with other values in the stretch."""
    late = (F.col(TS) >= F.lit(str(FROM)).cast("timestamp_ntz")) & (F.col(TS) < F.lit(str(UPTO)).cast("timestamp_ntz"))
    return df.withColumns({c: F.when(late, F.col(c) * 0.5 + 0.01).otherwise(F.col(c)) for c in columns})


@register("load_window", "SELECT * FROM raw_price", "price_eur_mwh")
def load_window(t):
    """Loaded month by month with wrong prices in a stretch, which a second load replaces."""
    path, prices = _table(t, "price"), t.stored("raw_price")
    middle = dt.datetime(2024, 1, 10)
    before = F.col(TS) < F.lit(str(middle)).cast("timestamp_ntz")
    wrong = _amiss(prices, "price_eur_mwh")
    layout.create_windowed(wrong.where(before), path)
    layout.load_window(wrong.where(~before), path, middle, LAST)
    layout.load_window(_stretch(prices), path, FROM, UPTO)
    return layout.read_window(t.spark, path)


@register("coverage_from_footers", COVERAGE)
def coverage_from_footers(t):
    """Rows and span of each hourly model without a column being read."""
    paths = {name: _table(t, name) for name in _hourly_models(t)}
    for name, df in _hourly_models(t).items():
        layout.create_windowed(df, paths[name], "month")
    return layout.coverage_from_footers(t.spark, paths)


@register("mart_from_buckets", "mart", MART)
def mart_from_buckets(t):
    """The solar mart from three bucketed tables, joined without a shuffle."""
    names = {"solar": t.stg_solar, "national": t.stg_weather_national, "operators": t.stg_tso}
    made = [catalog.register_bucketed(df, f"noonwatt_buckets.{n}", buckets=8) for n, df in names.items()]
    return marts.solar_features(*made, store=t.keep, buckets=[catalog.MONTH])


@register(
    "channel_p99_sketch",
    "SELECT channel, list_sort(e)[greatest(ceil(len(e) * 0.99), 1)::BIGINT] AS p99_kwh FROM (SELECT channel, "
    "list(energy_kwh) AS e FROM differenced WHERE energy_kwh IS NOT NULL GROUP BY channel)",
    "p99_kwh",
)
def channel_p99_sketch(t):
    """Each channel's 99th percentile from monthly sketches; exact while they hold all rows."""
    path = _table(t, "sketches")
    sketches.create(t.stored("metered"), path, ["channel"], "energy_kwh")
    return sketches.quantiles(t.spark, path, ["channel"], {"p99_kwh": 0.99})


@register(
    "score_recent_log",
    "SELECT * FROM scored WHERE target_date BETWEEN DATE '2024-01-20' AND DATE '2024-01-22'",
    "actual_capacity_factor tso_capacity_factor",
)
def score_recent_log(t):
    """Three days' forecasts scored against tables with daily partitions: only days of the
    log are read."""
    paths = {name: _table(t, name) for name in ("solar", "operators")}
    layout.create_windowed(t.stg_solar, paths["solar"])
    layout.create_windowed(t.stg_tso, paths["operators"])
    log = t.keep(t.prediction_log.where(F.col("target_date").between("2024-01-20", "2024-01-22")))
    return scoring.score_log(log, *[layout.read_days_of(log, p) for p in paths.values()])


@register("refresh_solar_mart", "mart", MART)
def refresh_solar_mart(t):
    """The mart built from wrong output in a stretch, then refreshed from there."""
    paths = {name: _table(t, name) for name in ("solar", "national", "operators", "mart")}
    wrong = _amiss(t.stg_solar, "solar_mw", vocab.TARGET)
    layout.create_windowed(wrong, paths["solar"])
    layout.create_windowed(t.stg_weather_national, paths["national"])
    layout.create_windowed(t.stg_tso, paths["operators"])
    inputs = [paths[name] for name in ("solar", "national", "operators")]
    stale = marts.solar_features(*[layout.read_window(t.spark, p) for p in inputs], store=t.keep)
    layout.create_windowed(stale, paths["mart"])
    layout.load_window(_stretch(t.stg_solar), paths["solar"], FROM, UPTO)
    incremental.refresh_solar_features(t.spark, paths["mart"], *inputs, FROM, UPTO, store=t.keep)
    return layout.read_window(t.spark, paths["mart"])
