from pyspark.sql import functions as F

from noonwatt.operators import quality
from noonwatt.plans import marts, staging

TS = "utc_timestamp"


def test_an_hour_needs_one_or_four_prices(table):
    rows = [("A", f"2024-01-01 00:{m:02d}:00", 10.0 * i) for i, m in enumerate((0, 15, 30, 45))]
    rows += [("A", "2024-01-01 01:00:00", -5.0)]
    rows += [("A", "2024-01-01 02:00:00", 1.0), ("A", "2024-01-01 02:15:00", 2.0)]
    rows += [("A", "2024-01-01 03:00:00", None)]
    raw = table(rows, "zone string, utc_timestamp timestamp_ntz, price_eur_mwh double")
    got = [tuple(r)[2:] for r in staging.price(raw).orderBy(TS).collect()]
    assert got == [(15.0, 4), (-5.0, 1)]
    assert staging.price_hourly_mean(raw).count() == 3


METER = "utc_timestamp timestamp_ntz, channel string, building string, building_type string, " \
        "device string, meter_kwh double"


def meter(*readings):
    return [
        (f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", "DE_KN_residential1_pv", "residential1",
         "residential", "pv", v)
        for h, v in readings
    ]


def test_gaps_and_resets_give_no_energy(table):
    raw = table(meter((0, 100.0), (1, 101.5), (2, 90.0), (5, 95.0), (6, 95.0)), METER)
    got = [r["energy_kwh"] for r in staging.meter_energy(raw).orderBy(TS).collect()]
    assert got == [None, 1.5, None, None, 0.0]


def test_a_replaced_meter_is_flagged_and_kept(table):
    steps = [(h, float(h)) for h in range(200)] + [(200, 700.0), (201, 701.0)]
    raw = table(meter(*steps), METER)
    for exact in (False, True):
        rows = staging.household(raw, exact=exact).where("is_implausible").collect()
        assert [r["energy_kwh"] for r in rows] == [501.0]


def test_demand_counts_own_solar(table):
    rows = []
    for device, used in (("grid_import", 2.0), ("pv", 3.0), ("grid_export", 1.0)):
        rows += [
            (f"2024-01-01 0{h}:00:00", f"c_{device}", "b1", "residential", device, 10 + used * h)
            for h in range(2)
        ]
    rows += [(f"2024-01-01 0{h}:00:00", "c2", "b2", "residential", "grid_import", 5.0 * h)
             for h in range(2)]
    load = staging.household_load(staging.household(table(rows, METER)))
    got = {r["building"]: (r["consumption_kwh"], r["has_pv"]) for r in load.collect()}
    assert got == {"b1": (4.0, True), "b2": (5.0, False)}


def test_late_capacity_is_carried_forward(hours, table):
    gen = hours("2024-01-31 20:00:00", 24 * 40).withColumn("solar_mw", F.lit(10.0))
    cap = table(
        [("A", "2024-01-01 00:00:00", 100.0), ("A", "2024-02-01 00:00:00", 200.0)],
        "zone string, month timestamp_ntz, solar_ac_mw double",
    )
    got = staging.solar_output(gen, cap).toPandas()
    local_month = got["local_datetime"].dt.month
    assert set(got[local_month == 1]["solar_ac_mw"]) == {100.0}
    assert set(got[local_month == 2]["solar_capacity_factor"]) == {0.05}
    march = got[local_month == 3]
    assert len(march) and set(march["solar_ac_mw"]) == {200.0}
    assert march["capacity_carried_forward"].all()


def test_capacity_before_the_first_report_is_unknown(hours, table):
    gen = hours("2024-01-10 00:00:00", 5).withColumn("solar_mw", F.lit(1.0))
    cap = table([("A", "2024-02-01 00:00:00", 5.0)],
                "zone string, month timestamp_ntz, solar_ac_mw double")
    assert staging.solar_output(gen, cap).where("solar_capacity_factor is not null").isEmpty()


def test_audits_find_what_they_look_for(table, hours):
    rows = [("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 00:00:00", 1),
            ("A", "2024-01-01 03:00:00", 3)]
    df = table(rows, "zone string, utc_timestamp timestamp_ntz, source_intervals bigint")
    found = {r["audit"]: r["violations"] for r in quality.violations("stg_price", df).collect()}
    assert found["duplicates"] == 1
    assert found["broken_grid"] == 2
    assert found["partial_hours"] == 1
    import pytest

    with pytest.raises(ValueError, match="stg_price failed its audits"):
        quality.enforce("stg_price", df)
    clean = hours("2024-01-01 00:00:00", 50).withColumn("source_intervals", F.lit(4))
    quality.enforce("stg_price", clean)


def test_mart_is_gate_safe_and_lagged(hours, spark):
    """Unbroken grid over both clock changes: audits pass, lags are by time."""
    from noonwatt import vocab

    solar = hours("2024-03-01 00:00:00", 24 * 260).withColumns(
        {
            "local_datetime": F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.col(TS)),
            "solar_mw": (F.col("id") % 97).cast("double"),
            "solar_ac_mw": F.lit(100.0),
        }
    ).withColumn("solar_capacity_factor", F.col("solar_mw") / 100)
    weather = solar.select(
        "zone", TS, *[F.lit(1.0).alias(c) for c in vocab.WEATHER_FEATURES],
        F.lit(9).alias("locations_reporting"),
    )
    tso = solar.select("zone", TS, F.col("solar_mw").alias("solar_forecast_mw"))
    mart = marts.solar_features(solar, weather, tso, block_rows=1000).cache()
    assert mart.count() == 24 * 260
    assert len(mart.columns) == 42  # 41 columns of the mart and the zone
    quality.enforce("mart_solar_features", mart)
    for lag in (48, 72, 168):
        name = f"capacity_factor_lag_{lag}h"
        assert quality.lag_mismatches(mart, name, vocab.TARGET, lag).isEmpty()
    assert {r["in_october"] > 0 for r in mart.where("horizon_hours = 36").groupBy().agg(
        F.count_if(F.month("local_datetime") == 10).alias("in_october")).collect()} == {True}


def test_targets_and_benchmark_are_never_features():
    from noonwatt import vocab

    assert len(vocab.FEATURES) == len(set(vocab.FEATURES)) == 32
    assert not set(vocab.FEATURES) & {*vocab.NEVER_FEATURES, vocab.TARGET, vocab.BENCHMARK}
