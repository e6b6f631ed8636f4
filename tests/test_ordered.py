"""The slotted operators must equal one plain window over the whole series."""

import pandas as pd
import pytest
from conftest import same
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.operators import ordered

TS = "utc_timestamp"


def plain():
    return W.partitionBy("zone").orderBy(TS)


@pytest.fixture(scope="module")
def gappy(hours):
    """Three zones with holes; one zone holds most rows; some values are NULL."""
    base = hours("2023-01-01 00:00:00", 5000, ("A", "B", "C"))
    h = F.pmod(F.xxhash64("id", "zone"), F.lit(1000))
    kept = base.where((F.col("zone") == "A") & (h > 40) | (F.col("zone") == "B") & (h > 700)
                      | (F.col("zone") == "C") & ~F.col("id").between(500, 3500) & (h > 300))
    value = F.when(h % 7 != 0, (h / 10).cast("double"))
    return kept.select("zone", TS, value.alias("v")).cache()


def test_positions_count_up_without_holes(gappy):
    got = ordered.with_position(gappy, ["zone"], TS, slot_hours=100)
    want = gappy.withColumn("position", (F.row_number().over(plain()) - 1).cast("bigint"))
    same(got, want, ["zone", TS])


@pytest.mark.parametrize("block", [300, 1000, 8192])
def test_trailing_rows_equal_a_plain_window(gappy, block):
    got = ordered.trailing_rows(
        gappy, ["zone"], TS,
        {"l48": ("v", 48), "l168": ("v", 168), "l0": ("v", 0)},
        {"m7": ("v", 215, 48), "m30": ("v", 767, 48), "now": ("v", 3, 0)},
        slot_hours=200, block_rows=block,
    )
    want = gappy.withColumns(
        {
            "l48": F.lag("v", 48).over(plain()),
            "l168": F.lag("v", 168).over(plain()),
            "l0": F.col("v"),
            "m7": F.avg("v").over(plain().rowsBetween(-215, -48)),
            "m30": F.avg("v").over(plain().rowsBetween(-767, -48)),
            "now": F.avg("v").over(plain().rowsBetween(-3, 0)),
        }
    )
    same(got, want, ["zone", TS])


def test_look_backs_must_point_back(gappy):
    with pytest.raises(ValueError):
        ordered.trailing_rows(gappy, ["zone"], TS, {"x": ("v", -1)})
    with pytest.raises(ValueError):
        ordered.trailing_rows(gappy, ["zone"], TS, means={"x": ("v", 10, 20)})


def test_no_task_gets_a_whole_series(gappy):
    made = ordered.trailing_rows(gappy, ["zone"], TS, {"l": ("v", 48)}, block_rows=500)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("slot", [24, 700])
def test_previous_row_reaches_across_slots(gappy, slot):
    got = ordered.previous_row(gappy, ["zone"], TS, {"pv": "v", "pt": TS}, slot_hours=slot)
    want = gappy.withColumns({"pv": F.lag("v").over(plain()), "pt": F.lag(TS).over(plain())})
    same(got, want, ["zone", TS])


@pytest.mark.parametrize("slot", [24, 700])
def test_carry_forward(gappy, slot):
    sparse = gappy.withColumn("v", F.when(F.dayofmonth(TS) == 3, F.col("v")))
    got = ordered.carry_forward(sparse, ["zone"], TS, {"f": "v"}, slot_hours=slot)
    upto = plain().rowsBetween(W.unboundedPreceding, 0)
    want = sparse.withColumn("f", F.last("v", ignorenulls=True).over(upto))
    same(got, want, ["zone", TS])


def test_running_total_is_exact_for_decimals(gappy):
    money = gappy.withColumn("v", F.coalesce("v", F.lit(0.0)).cast("decimal(18,2)"))
    got = ordered.running_total(money, ["zone"], TS, "v", "t", slot_hours=50)
    want = money.withColumn("t", F.sum("v").over(plain().rowsBetween(W.unboundedPreceding, 0)))
    assert got.select("zone", TS, "t").exceptAll(want.select("zone", TS, "t")).isEmpty()


def test_rolling_hours(gappy):
    got = ordered.rolling_hours(gappy, ["zone"], TS, "v", {"w": 168, "m": 720}, block_hours=500)
    seconds = W.partitionBy("zone").orderBy(F.unix_seconds(F.col(TS).cast("timestamp")))
    want = gappy.withColumns(
        {
            "w": F.avg("v").over(seconds.rangeBetween(-(168 * 3600 - 1), 0)),
            "m": F.avg("v").over(seconds.rangeBetween(-(720 * 3600 - 1), 0)),
        }
    )
    same(got, want, ["zone", TS])


def test_lags_by_time_skip_holes(gappy):
    spine = gappy.select("zone", TS)
    got = ordered.value_at(spine, gappy, ["zone"], TS, "v", {"l48": 48, "l72": 72})
    want = spine
    for n in (48, 72):
        shifted = gappy.select(
            "zone", (F.col(TS) + F.make_dt_interval(hours=F.lit(n))).alias(TS),
            F.col("v").alias(f"l{n}"),
        )
        want = want.join(shifted, ["zone", TS], "left")
    same(got, want, ["zone", TS])


@pytest.mark.parametrize("offset", [0, 48])
def test_asof_equals_a_sorted_merge(gappy, hours, offset):
    spine = hours("2022-12-30 00:00:00", 5200, ("A", "C", "Z")).select("zone", TS)
    got = ordered.asof_backward(
        spine, gappy, ["zone"], TS, ["v"], offset_hours=offset, slot_hours=300
    ).toPandas().sort_values(["zone", TS]).reset_index(drop=True)
    left = spine.toPandas().sort_values([TS, "zone"])
    left["at"] = left[TS] - pd.Timedelta(offset, "h")
    right = gappy.toPandas().rename(columns={TS: "at"}).sort_values("at")
    want = pd.merge_asof(left.sort_values("at"), right, on="at", by="zone")
    want = want.sort_values(["zone", TS]).reset_index(drop=True)
    pd.testing.assert_series_equal(got["v"].astype(float), want["v"].astype(float))


def test_gap_minutes_marks_holes(table):
    rows = [("A", "2024-01-01 00:00:00"), ("A", "2024-01-01 01:00:00"), ("A", "2024-01-01 04:00:00")]
    got = ordered.gap_minutes(table(rows, "zone string, utc_timestamp timestamp_ntz"), ["zone"])
    assert [r["step_minutes"] for r in got.orderBy(TS).collect()] == [None, 60, 180]


def test_join_small_keeps_every_row(gappy, spark):
    names = spark.createDataFrame([("A", 1), ("B", 2)], "zone string, n int")
    assert ordered.join_small(gappy, names, ["zone"]).count() == gappy.where("zone != 'C'").count()
    left = ordered.join_small(gappy, names, ["zone"], "left")
    assert left.count() == gappy.count()
    assert left.where("zone = 'C' and n is not null").isEmpty()
    with pytest.raises(ValueError):
        ordered.join_small(gappy, names, ["zone"], "full")


def test_rows_with_null_keys_or_times_stay(spark):
    rows = [("A", "2024-01-01 00:00:00", 1.0), ("A", "2024-01-01 01:00:00", 2.0), (None, "2024-01-01 00:00:00", 3.0),
            (None, "2024-01-01 01:00:00", 4.0), ("A", None, 5.0)]
    df = spark.createDataFrame(rows, "zone string, at string, v double").selectExpr("zone", "cast(at as timestamp_ntz) AS at", "v")
    one = ["zone"]
    lagged = ordered.trailing_rows(df, one, "at", {"before": ("v", 1)}, {"mean": ("v", 1, 0)})
    got = {(r.zone, str(r.at), r.v): (r.before, r["mean"]) for r in lagged.collect()}
    assert len(got) == 5
    assert got[None, "2024-01-01 01:00:00", 4.0] == (3.0, 3.5)
    assert got["A", "2024-01-01 00:00:00", 1.0] == (5.0, 3.0)  # no time comes first
    for made in (
        ordered.with_position(df, one, "at"), ordered.previous_row(df, one, "at", {"p": "v"}),
        ordered.carry_forward(df, one, "at", {"c": "v"}), ordered.running_total(df, one, "at", "v", "t"),
        ordered.gap_minutes(df, one, "at"), ordered.rolling_hours(df, one, "at", "v", {"m": 2}),
    ):
        assert made.count() == 5


def test_an_infinite_value_spoils_only_its_own_frames(spark, hours):
    base = hours("2024-01-01 00:00:00", 100).withColumn(
        "v", F.when(F.col("id") == 40, float("inf")).when(F.col("id") == 60, float("nan")).otherwise(F.col("id").cast("double"))
    )
    got = ordered.trailing_rows(base, ["zone"], "utc_timestamp", means={"m": ("v", 9, 0)})
    frame = W.partitionBy("zone").orderBy("utc_timestamp").rowsBetween(-9, 0)
    rolled = ordered.rolling_hours(base, ["zone"], "utc_timestamp", "v", {"r": 10})
    want = {r.id: str(r.w) for r in base.withColumn("w", F.avg("v").over(frame)).collect()}
    assert {r.id: str(r.m) for r in got.collect()} == want
    assert {r.id: str(r.r) for r in rolled.collect()} == want
