"""Schedules are checked by what must hold for any optimum, and against a second,
independent search over a fine grid of charge levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noonwatt.operators.explore import annualise
from noonwatt.plans import dispatch

TS = "utc_timestamp"
HOME = ("B0", 0.010, 0.005, 0.90)
SHAPES = [HOME, ("B1", 0.010, 0.003, 0.80), ("B2", 0.020, 0.007, 0.95),
          ("B3", 0.005, 0.005, 0.90), ("B4", 0.010, 0.005, 1.0), ("B5", 0.050, 0.0025, 0.9)]
RNG = np.random.default_rng(7)
PRICES = {
    "cheap_then_dear": [10.0] * 12 + [100.0] * 12,
    "flat": [50.0] * 24,
    "negative_first": [-50.0] * 6 + [30.0] * 18,
    "all_negative": [-5.0] * 24,
    "negative_then_peak": [-3.0] * 12 + [180.0] * 12,
    "narrow": [40.0] * 12 + [60.0] * 12,
    "wide": [10.0] * 12 + [200.0] * 12,
    **{f"random{i}": RNG.normal(40, 60, 24).round(2).tolist() for i in range(12)},
}


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [(z, *b) for z in PRICES for b in SHAPES]
    return spark.createDataFrame(
        rows, "zone string, battery_id string, energy_mwh double, power_mw double, "
        "round_trip_efficiency double"
    )


@pytest.fixture(scope="module")
def prices(spark, table):
    # 2025-01-01 in local time begins at 23:00 UTC the day before.
    rows = [
        (z, f"2025-01-01 {h - 1:02d}:00:00" if h else "2024-12-31 23:00:00", p)
        for z, day in PRICES.items()
        for h, p in enumerate(day)
    ]
    return table(rows, "zone string, utc_timestamp timestamp_ntz, price_eur_mwh double")


@pytest.fixture(scope="module")
def schedules(prices, fleet):
    planned = dispatch.dispatch(dispatch.price_days(prices), fleet)
    return planned.toPandas().set_index(["zone", "battery_id"])


def test_every_day_and_battery_is_planned(schedules):
    assert len(schedules) == len(PRICES) * len(SHAPES)


def test_limits_hold_and_the_day_ends_where_it_started(schedules):
    for (_, battery), row in schedules.iterrows():
        energy, power, rt = row["energy_mwh"], row["power_mw"], row["round_trip_efficiency"]
        charge, discharge = np.array(row["charge_mw"]), np.array(row["discharge_mw"])
        level = np.array(row["state_of_charge_mwh"])
        assert min(charge.min(), discharge.min()) >= 0
        assert (charge + discharge).max() <= power + 1e-9
        assert not ((charge > 1e-9) & (discharge > 1e-9)).any()
        assert level.min() >= -1e-9 and level.max() <= energy + 1e-9
        assert level[-1] == pytest.approx(energy / 2, abs=1e-9)
        moved = np.diff(np.concatenate([[energy / 2], level]))
        eta = np.sqrt(rt)
        np.testing.assert_allclose(moved, eta * charge - discharge / eta, atol=1e-9)


def test_known_shapes(schedules):
    revenue = schedules["planned_revenue_eur"]
    assert revenue["flat", "B0"] == pytest.approx(0, abs=1e-9)
    assert revenue["wide", "B0"] > revenue["narrow", "B0"]
    assert revenue["negative_first", "B0"] > 0
    assert revenue["cheap_then_dear", "B4"] > revenue["cheap_then_dear", "B0"] > 0
    day = schedules.loc[("cheap_then_dear", "B0")]
    assert sum(day["charge_mw"][:12]) > 0 and sum(day["discharge_mw"][12:]) > 0
    assert sum(day["discharge_mw"][:12]) == pytest.approx(0, abs=1e-9)
    assert sum(schedules.loc[("negative_first", "B0")]["charge_mw"][:6]) > 0


def grid_search(prices, energy, power, rt, points=801):
    """Best revenue when the charge may only take equally spaced levels."""
    eta = np.sqrt(rt)
    level = np.linspace(0, energy, points)
    step = level[None, :] - level[:, None]
    net = np.where(step > 0, step / eta, step * eta)
    net = np.where((net <= power + 1e-12) & (net >= -power - 1e-12), net, np.nan)
    best = np.full(points, -np.inf)
    best[points // 2] = 0.0
    for p in prices:
        gain = best[:, None] - np.where(np.isnan(net), np.inf, p * net)
        gain[np.isnan(net)] = -np.inf
        best = gain.max(axis=0)
    return best[points // 2]


@pytest.mark.parametrize("battery", SHAPES[:5], ids=lambda b: b[0])
def test_never_below_a_fine_grid_and_close_to_it(schedules, battery):
    name, energy, power, rt = battery
    for zone, day in PRICES.items():
        found = schedules.loc[(zone, name)]["planned_revenue_eur"]
        grid = grid_search(day, energy, power, rt)
        scale = energy * (max(day) - min(day) + 1)
        assert found >= grid - 1e-9, zone
        assert found <= grid + 0.02 * scale, zone


def days_of(hours, shape, start="2024-12-31 23:00:00", days=10):
    n = 24 * days
    at = F.get(F.array(*[F.lit(x) for x in shape]), (F.col("id") % 24).cast("int"))
    return hours(start, n).select("zone", TS, at.alias("price_eur_mwh"))


def one_battery(spark, battery=HOME, zone="A"):
    return spark.createDataFrame(
        [(zone, *battery)], "zone string, battery_id string, energy_mwh double, power_mw double, "
        "round_trip_efficiency double"
    )


def test_partial_days_are_left_out(hours, spark):
    prices = days_of(hours, PRICES["cheap_then_dear"])
    fleet = one_battery(spark)
    assert dispatch.perfect_foresight(prices, fleet).count() == 10
    cut = prices.where(F.col(TS) < F.lit("2025-01-10 18:00:00").cast("timestamp_ntz"))
    assert dispatch.perfect_foresight(cut, fleet).count() == 9


def test_clock_change_days_are_left_out(hours, spark):
    prices = days_of(hours, PRICES["cheap_then_dear"], "2024-10-24 22:00:00", 5)
    days = {str(r["day"]) for r in dispatch.perfect_foresight(prices, one_battery(spark)).collect()}
    assert "2024-10-27" not in days and "2024-10-26" in days and "2024-10-28" in days


def test_a_forecast_earns_no_more_than_foresight(hours, spark):
    prices = days_of(hours, PRICES["random0"]).withColumn(
        "price_eur_mwh", F.col("price_eur_mwh") * (1 + F.dayofmonth(TS) % 3) - 7 * F.hour(TS) * (F.dayofmonth(TS) % 2)
    )
    fleet = one_battery(spark)
    perfect = dispatch.perfect_foresight(prices, fleet)
    naive = dispatch.previous_day_prices(prices, fleet)
    both = perfect.alias("p").join(naive.alias("n"), ["zone", "day"])
    assert both.count() == 9
    assert both.where("n.revenue_eur > p.revenue_eur + 1e-9").isEmpty()
    summary = dispatch.strategy_summary(perfect, naive).toPandas().set_index("strategy")
    assert summary.loc[dispatch.PERFECT, "capture_rate"] == 1
    assert summary.loc[dispatch.NAIVE, "capture_rate"] <= 1.01


def test_annual_figures(hours, spark):
    daily = dispatch.perfect_foresight(days_of(hours, PRICES["cheap_then_dear"]), one_battery(spark))
    row = annualise(daily, ["zone", "battery_id"]).collect()[0]
    assert row["days"] == 10
    assert row["annual_eur"] == pytest.approx(row["mean_daily_eur"] * 365.25)
    assert 0 < row["cycles_per_day"] <= 4
    assert annualise(daily.where("false"), ["zone"]).isEmpty()


def test_unreadable_prices_are_refused(spark, prices, fleet):
    broken = prices.withColumn(
        "price_eur_mwh", F.when(F.hour(TS) == 5, float("nan")).otherwise(F.col("price_eur_mwh"))
    )
    with pytest.raises(Exception, match="NaN"):
        dispatch.dispatch(dispatch.price_days(broken), fleet).collect()


@pytest.mark.parametrize(
    "battery", [("X", 0.0, 0.005, 0.9), ("X", 0.01, -1.0, 0.9), ("X", 0.01, 0.005, 0.0),
                ("X", 0.01, 0.005, 1.5)],
)
def test_impossible_batteries_are_refused(spark, hours, battery):
    prices = days_of(hours, PRICES["flat"], days=1)
    with pytest.raises(Exception, match="a battery"):
        dispatch.perfect_foresight(prices, one_battery(spark, battery)).collect()
