import datetime as dt

import pytest
from pyspark.sql import functions as F

from noonwatt.functions.calendar import hour_spine
from noonwatt.operators import profile, scoring
from noonwatt.plans import dayplan

TS = "utc_timestamp"
DAY = dt.date(2026, 8, 2)


@pytest.fixture(scope="module")
def prediction(spark):
    day = F.lit(str(DAY)).cast("date")
    spine = spark.range(1).select(F.lit("A").alias("zone"), F.posexplode(hour_spine(day)).alias("h", TS))
    cf = F.greatest(F.lit(0.0), F.sin((F.col("h") - 6) / 12 * 3.14159265)) * 0.4
    return spine.select("zone", TS, "h", cf.alias("predicted_capacity_factor"), day.alias("target_date"))


@pytest.fixture(scope="module")
def prices(prediction):
    price = F.when(F.col("h") < 12, 20.0).otherwise(140.0) + F.col("h") / 100
    return prediction.select("zone", TS, price.alias("price_eur_mwh"))


@pytest.fixture(scope="module")
def batteries(spark):
    return spark.createDataFrame(
        [("B0", 0.010, 0.005, 0.90)],
        "battery_id string, energy_mwh double, power_mw double, round_trip_efficiency double")


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(
        [(1, "A", "B0", 5.0, "b1"), (2, "A", "B0", 20.0, "b1"), (3, "A", "B0", 20.0, "b9")],
        "site_id bigint, zone string, battery_id string, system_kwp double, building string")


@pytest.fixture(scope="module")
def load(prediction):
    return prediction.select(F.lit("b1").alias("building"), TS, F.lit(0.8).alias("load_kwh"))


@pytest.fixture(scope="module")
def days(prediction, prices, sites, batteries, load):
    return dayplan.planned_days(prediction, prices, sites, batteries, load).cache()


@pytest.fixture(scope="module")
def plan(prediction, prices, sites, batteries, load):
    return dayplan.plan_hours(prediction, prices, sites, batteries, load).cache()


def test_a_flat_draw_can_be_set(prediction, prices, sites, batteries):
    flat = dayplan.planned_days(prediction, prices, sites, batteries, flat_mw=0.001)
    assert {r.expected_load_kw[0] for r in flat.collect()} == {1.0}


def test_a_plan_covers_every_hour(plan):
    for site in (1, 2, 3):
        hours = [r["local_hour"] for r in plan.where(F.col("site_id") == site).collect()]
        assert sorted(hours) == list(range(24))


def test_it_charges_cheap_and_discharges_dear(plan):
    row = plan.agg(
        F.max(F.when(F.col("charge_kw") > 0.01, F.col("price_eur_mwh"))).alias("c"),
        F.min(F.when(F.col("discharge_kw") > 0.01, F.col("price_eur_mwh"))).alias("d"),
    ).collect()[0]
    assert row["c"] < row["d"]


def test_worth_adds_up_and_grows_with_the_array(days):
    rows = {r["site_id"]: r for r in dayplan.plan_days(days).collect()}
    for r in rows.values():
        assert r["revenue_eur"] > 0 and r["solar_value_eur"] > 0
        assert r["total_benefit_eur"] == pytest.approx(r["revenue_eur"] + r["solar_value_eur"])
    assert rows[2]["solar_value_eur"] > rows[1]["solar_value_eur"]
    totals = {r["site_id"]: r for r in dayplan.day_totals(days).collect()}
    assert totals[2]["expected_consumption_kwh"] == pytest.approx(24 * 0.8)
    assert totals[3]["expected_consumption_kwh"] == pytest.approx(24 * 0.4), "flat draw"


def test_advice_is_actionable(days):
    row = dayplan.advice(days).where("site_id = 1").collect()[0]
    assert row["cheapest_hours"] == "00:00, 01:00, 02:00"
    assert row["dearest_hours"] == "21:00, 22:00, 23:00"
    assert row["solar_peak_hour"] == 12
    text = " ".join(row["advice"])
    for word in ("Cheapest power at 00:00", "Charge from the grid", "Discharge around",
                 "Solar peaks near 12:00 at 2.0 kW", "2026-08-02: EUR"):
        assert word in text
    assert len(row["advice"]) == 5


def test_a_day_without_all_prices_is_not_planned(prediction, prices):
    few = prices.where(F.hour(TS) < 10)
    assert dayplan.priced_hours(prediction, few, strict=False).isEmpty()
    with pytest.raises(ValueError, match="24 priced hours"):
        dayplan.priced_hours(prediction, few)


def test_a_zone_without_a_priced_day_is_named(prediction, prices):
    other = prediction.withColumn("zone", F.lit("other"))
    some = prices.unionByName(prices.withColumn("zone", F.lit("other")).where(F.hour(TS) < 10))
    with pytest.raises(ValueError, match=r"24 priced hours.*\(for other\)"):
        dayplan.priced_hours(prediction.unionByName(other), some)


# --- household profiles ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def metered(hours):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.col(TS))
    base = hours("2016-12-31 23:00:00", 24 * 7 * 30).withColumn("local_datetime", local)
    peak = F.when(F.hour("local_datetime").isin(7, 8, 19, 20), 1.5).otherwise(0.4)
    weekend = F.when(F.weekday("local_datetime") >= 5, 0.3).otherwise(0.0)
    return base.select(TS, "local_datetime", F.lit("b1").alias("building"),
                       (peak + weekend).alias("consumption_kwh"))


def test_a_profile_has_168_cells_and_the_right_level(metered):
    fitted = profile.fit_profiles(metered)
    assert fitted.count() == 168
    level = profile.profile_level(fitted).collect()[0]
    mean = metered.agg(F.avg("consumption_kwh")).collect()[0][0]
    assert level["daily_kwh"] == pytest.approx(24 * mean, rel=0.02)
    assert level["hours_observed"] == 24 * 7 * 30
    scored = profile.score_profiles(metered, fitted).collect()[0]
    assert scored["profile_mae_kwh"] == pytest.approx(0, abs=1e-9)
    assert scored["improvement"] == pytest.approx(1)


def test_unseen_hours_take_the_mean(metered, spark):
    weekdays = metered.where(F.weekday("local_datetime") < 5)
    fitted = profile.fit_profiles(weekdays)
    days = spark.sql("select 'b1' building, date'2026-08-02' day")  # a Sunday
    got = profile.profile_for_days(fitted, days).collect()
    mean = weekdays.agg(F.avg("consumption_kwh")).collect()[0][0]
    assert len(got) == 24
    assert {round(r["load_kwh"], 9) for r in got} == {round(mean, 9)}


# --- saved forecasts ----------------------------------------------------------------------------

SCORED = ("zone string, utc_timestamp timestamp_ntz, target_date string, predicted_capacity_factor "
          "double, actual_capacity_factor double, tso_capacity_factor double, ghi_mean_forecast double")


def scored(table, tso):
    mine, real = [0.10, 0.20, 0.30, 0.25, 0.15, 0.05], [0.12, 0.18, 0.28, 0.27, 0.14, 0.06]
    light = [100.0, 400.0, 700.0, 500.0, 200.0, 0.0]
    return table([("A", f"2026-08-02 {8 + i:02d}:00:00", "2026-08-02", mine[i], real[i], tso, light[i])
                  for i in range(6)], SCORED)


def test_scores_leave_night_out(table):
    rows = {r["source"]: r for r in scoring.score_summary(scored(table, 0.2)).collect()}
    assert set(rows) == {"our forecast", "TSO forecast"}
    assert rows["our forecast"]["hours"] == 5
    assert rows["our forecast"]["mae"] == pytest.approx(0.018)


def test_scores_without_a_benchmark(table):
    rows = scoring.score_summary(scored(table, None)).collect()
    assert [r["source"] for r in rows] == ["our forecast"]


def test_latest_issue_wins_per_hour_or_per_model(table):
    log = table(
        [("A", "2026-08-02 08:00:00", "2026-08-01 10:00:00", "ridge", 1.0),
         ("A", "2026-08-02 08:00:00", "2026-08-01 12:00:00", "ridge", 2.0),
         ("A", "2026-08-02 08:00:00", "2026-08-01 11:00:00", "trees", 3.0)],
        "zone string, utc_timestamp timestamp_ntz, issued_at timestamp_ntz, model_name string, v double")
    assert [r["v"] for r in scoring.latest_issues(log).collect()] == [2.0]
    assert {r["v"] for r in scoring.latest_issues(log, per_model=True).collect()} == {2.0, 3.0}
