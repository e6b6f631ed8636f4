"""Clock changes: 2024-03-31 has 23 local hours, 2024-10-27 has 25."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noonwatt.functions import calendar as cal
from noonwatt.functions import numbers, text

TS = "utc_timestamp"


def gated(hours, start):
    local = cal.to_market(TS)
    df = hours(start, 120).withColumns(
        {"local": local, "day": F.to_date(local), "gate": cal.gate(local)}
    )
    return df.withColumn("horizon", cal.hours_between("gate", TS)).toPandas()


@pytest.mark.parametrize(
    "start, day, length, gate, longest",
    [
        ("2024-03-29 00:00:00", dt.date(2024, 3, 31), 23, "2024-03-30 11:00", 34),
        ("2024-10-25 00:00:00", dt.date(2024, 10, 27), 25, "2024-10-26 10:00", 36),
        ("2024-06-01 00:00:00", dt.date(2024, 6, 3), 24, "2024-06-02 10:00", 35),
    ],
)
def test_gate_and_horizon(hours, start, day, length, gate, longest):
    pdf = gated(hours, start)
    of_day = pdf[pdf["day"] == day]
    assert len(of_day) == length
    assert set(of_day["gate"].astype(str)) == {f"{gate}:00"}
    assert of_day["horizon"].min() == 12
    assert of_day["horizon"].max() == longest


def test_the_day_spine_always_has_24_hours(spark):
    days = spark.sql("select explode(array(date'2024-03-31', date'2024-10-27', date'2024-06-01')) d")
    sizes = days.select(F.size(cal.hour_spine("d")).alias("n"), cal.day_start_utc("d").alias("s"))
    rows = sizes.collect()
    assert [r["n"] for r in rows] == [24, 24, 24]
    assert [str(r["s"]) for r in rows] == [
        "2024-03-30 23:00:00", "2024-10-26 22:00:00", "2024-05-31 22:00:00",
    ]


def test_week_starts(spark):
    # 2026-08-02 is a Sunday.
    day = F.lit("2026-08-02 05:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(
        cal.calendar_columns(day)["day_of_week"].alias("dow"),
        cal.hour_of_week(day).alias("how"),
        cal.is_weekend(day).alias("weekend"),
    ).collect()[0]
    assert tuple(row) == (1, 6 * 24 + 5, True)


@pytest.mark.parametrize("hour", ["00:30", "09:00", "14:00", "21:59"])
def test_the_target_is_always_tomorrow(spark, hour):
    now = F.lit(f"2026-08-01 {hour}:00").cast("timestamp_ntz")
    row = spark.range(1).select(cal.target_day(now).alias("d"), cal.prices_expected(now).alias("p"))
    target, published = row.collect()[0]
    assert target == dt.date(2026, 8, 2)
    assert published == (int(hour[:2]) + 2 >= 13)


def test_parsing_and_null_rules(spark):
    row = spark.range(1).select(
        cal.from_month_label(F.lit("07.2022")).alias("month"),
        cal.from_iso(F.lit("2024-01-01T05:00")).alias("short"),
        cal.from_iso(F.lit("2024-01-01T05:00:00Z")).alias("zulu"),
        cal.from_epoch(F.lit(1704067200)).alias("epoch"),
        numbers.to_number(F.lit("n/a")).alias("word"),
        numbers.to_number(F.lit("NaN")).alias("nan"),
        numbers.to_number(F.lit("-3.5")).alias("negative"),
        numbers.ratio(F.lit(1.0), F.lit(0.0)).alias("ratio"),
        numbers.clip_unit(F.lit(1.7)).alias("high"),
        numbers.watts_clean(F.lit(-1e-17)).alias("zero"),
        text.hour_list(F.array(F.lit(11), F.lit(2), F.lit(2))).alias("list"),
    ).collect()[0]
    assert str(row["month"]) == "2022-07-01 00:00:00"
    assert str(row["short"]) == str(row["zulu"]) == "2024-01-01 05:00:00"
    assert str(row["epoch"]) == "2024-01-01 00:00:00"
    assert (row["word"], row["nan"], row["negative"]) == (None, None, -3.5)
    assert (row["ratio"], row["high"], row["zero"]) == (None, 1.0, 0.0)
    assert row["list"] == "02:00, 11:00"


def test_channel_names(spark):
    names = ["DE_KN_residential4_heat_pump", "DE_KN_industrial3_area_room_1", "other"]
    df = spark.createDataFrame([(n,) for n in names], "channel string")
    parts = df.select(*[c.alias(n) for n, c in text.channel_parts("channel").items()]).collect()
    assert tuple(parts[0]) == ("residential4", "residential", "heat_pump")
    assert tuple(parts[1]) == ("industrial3", "industrial", "area_room_1")
    assert tuple(parts[2]) == (None, None, None)
