"""Several zones at once give what each zone gives alone. Zones hold unequal shares of the
rows and start at different times."""

from pathlib import Path

import pytest
from conftest import same
from pyspark.sql import functions as F

from noonwatt.operators import ordered
from noonwatt.plans import backtest, dispatch, marts, staging
from workload import adapters

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
TS = "utc_timestamp"
ZONES = ("Z0", "Z1", "Z2", "Z3")


def uneven(df):
    """Z0 keeps all rows, Z1 begins on the 8th, Z2 on the 15th; Z3 has every hour but few days."""
    start = F.create_map(*[F.lit(x) for x in ("Z0", "2024-01-01", "Z1", "2024-01-08", "Z2", "2024-01-15", "Z3", "2024-01-20")])
    return df.where(F.to_date(TS) >= F.try_element_at(start, F.col("zone")).cast("date"))


@pytest.fixture(scope="module")
def raw(spark):
    made = {
        "price": adapters.raw_price(spark, SF, 4),
        "power": adapters.raw_public_power(spark, SF, 4),
        "forecast": adapters.raw_day_ahead_forecast(spark, SF, 4),
        "weather": adapters.raw_weather(spark, SF, 4),
    }
    tables = {name: uneven(df).cache() for name, df in made.items()}
    tables["capacity"] = adapters.raw_event_capacity(spark, SF, 4).cache()
    return tables


def mart(t):
    solar = staging.solar_output(staging.generation(t["power"]), staging.capacity(t["capacity"]))
    weather = staging.weather_national(staging.weather(t["weather"]))
    return marts.solar_features(solar, weather, staging.operator_forecast(t["forecast"]))


def prices(t):
    return staging.price_hourly_mean(t["price"])


def fleet(df):
    batteries = adapters.batteries(df.sparkSession)
    each = F.explode(F.array(*[F.lit(f"B{i}") for i in range(5)])).alias("battery_id")
    return df.select("zone").distinct().select("zone", each).join(batteries, "battery_id")


def lags(t):
    return ordered.trailing_rows(prices(t), ["zone"], TS, {"a": ("price_eur_mwh", 24)}, {"m": ("price_eur_mwh", 30, 2)}, 48, 16)


def rolled(t):
    return ordered.rolling_hours(prices(t), ["zone"], TS, "price_eur_mwh", {"r": 31}, 40)


def walked(t):
    small = mart(t).withColumn("ghi_max", F.coalesce("ghi_max", F.lit(1.0)))
    return backtest.backtest(small, (backtest.PERSISTENCE, backtest.CLIMATOLOGY), 4, 3, strict=False)


CASES = {
    "prices": (prices, ["zone", TS]),
    "mart": (mart, ["zone", TS]),
    "lags": (lags, ["zone", TS]),
    "rolled": (rolled, ["zone", TS]),
    "perfect": (lambda t: dispatch.perfect_foresight(prices(t), fleet(t["price"])), ["zone", "day", "battery_id"]),
    "naive": (lambda t: dispatch.previous_day_prices(prices(t), fleet(t["price"])), ["zone", "day", "battery_id"]),
    "backtest": (walked, ["zone", TS]),
}


@pytest.mark.parametrize("name", CASES)
def test_zones_together_like_alone(raw, name):
    make, keys = CASES[name]
    together = make(raw).cache()
    alone = None
    for zone in ZONES:
        one = make({n: df.where(F.col("zone") == zone) for n, df in raw.items()})
        alone = one if alone is None else alone.unionByName(one)
    assert together.select("zone").distinct().count() > 1
    same(together, alone, keys)
