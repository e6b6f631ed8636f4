import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.sources import payloads, tables

TS = "utc_timestamp"


@pytest.fixture
def landed(tmp_path, spark):
    """``landed(name, *docs)``: JSON files in a directory, read one per row."""

    def make(name, *docs, partition=None):
        for i, doc in enumerate(docs):
            folder = tmp_path / name / (f"location={partition[i]}" if partition else ".")
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{i}.json").write_text(json.dumps(doc))
        return payloads.read_documents(spark, str(tmp_path / name))

    return make


HOURS = [1704067200, 1704070800, 1704074400]


def test_prices_keep_negatives_and_null_words(landed):
    docs = landed("price", {"unix_seconds": HOURS, "price": [12.5, -3.25, "n/a"], "unit": "EUR"},
                  {"unix_seconds": [1704078000], "price": [None]})
    rows = payloads.price(docs).orderBy(TS).collect()
    assert [r["price_eur_mwh"] for r in rows] == [12.5, -3.25, None, None]
    assert str(rows[0][TS]) == "2024-01-01 00:00:00"


def test_a_response_without_instants_fails_with_its_reason(landed):
    with pytest.raises(Exception, match="no unix_seconds"):
        payloads.price(landed("bad", {"price": [1.0]})).collect()


def test_upcoming_prices_drop_what_is_unpublished(landed):
    docs = landed("soon", {"unix_seconds": HOURS + [1704672000], "price": [1, None, 3, 4]})
    rows = payloads.upcoming_price(docs, F.lit("2024-01-01").cast("date")).collect()
    assert sorted(r["price_eur_mwh"] for r in rows) == [1.0, 3.0]


def test_power_is_one_row_per_instant_and_type(landed):
    doc = {"unix_seconds": HOURS, "production_types": [
        {"name": "Solar", "data": [0, None, 5.5]}, {"name": "Load", "data": [50, 51, 52]}]}
    rows = payloads.public_power(landed("power", doc)).collect()
    assert len(rows) == 6
    assert {r["power_mw"] for r in rows if r["production_type"] == "Solar"} == {0.0, None, 5.5}


def test_forecast_documents_of_several_types_are_read_together(landed):
    docs = landed("tso", *[
        {"unix_seconds": HOURS, "forecast_values": [1, 2, 3], "production_type": p,
         "forecast_type": "day-ahead"} for p in ("solar", "load", "nuclear")])
    got = payloads.operator_forecast(docs)
    assert {r["production_type"] for r in got.collect()} == {"solar", "load"}
    assert got.count() == 6


def test_capacity_is_monthly_and_in_mw(landed):
    doc = {"time": ["01.2022", "02.2022"], "production_types": [
        {"name": "Solar AC", "data": [58.5, None]}, {"name": "Solar DC", "data": [60, 61]}]}
    rows = payloads.installed_power(landed("capacity", doc)).collect()
    assert {(str(r["month"])[:10], r["capacity_mw"]) for r in rows if r["production_type"] == "Solar AC"} \
        == {("2022-01-01", 58500.0), ("2022-02-01", None)}


def weather_doc(drop=None):
    names = [*vocab.WEATHER_VARIABLES]
    names += [n + vocab.PREVIOUS_DAY_SUFFIX for n in names]
    hourly = {n: [i + 0.5, None, "x"] for i, n in enumerate(names) if n != drop}
    times = ["2024-01-20T00:00", "2024-01-20T01:00", "2024-01-20T02:00"]
    return {"latitude": 1.5, "longitude": 2.5, "hourly": {"time": times, **hourly}}


def test_weather_carries_both_leads(landed):
    docs = landed("weather", weather_doc(), weather_doc(), partition=["berlin", "munich"])
    got = payloads.weather_archive(docs)
    assert got.count() == 6
    row = got.where("location = 'munich'").orderBy(TS).first()
    assert row["temperature_c"] == 0.5 and row["temperature_c_day_ahead"] == 5.5
    forward = payloads.weather_forward(docs, F.lit("2024-01-20").cast("date"))
    assert "ghi_wm2_day_ahead" not in forward.columns and forward.count() == 6
    assert payloads.weather_forward(docs, F.lit("2024-01-22").cast("date")).isEmpty()


def test_a_missing_variable_fails_the_read(landed):
    docs = landed("thin", weather_doc("cloud_cover_previous_day1"), partition=["berlin"])
    with pytest.raises(Exception, match="cloud_cover_previous_day1"):
        payloads.weather_archive(docs).collect()
    assert payloads.weather_forward(docs, F.lit("2024-01-20").cast("date")).count() == 3


def test_the_archive_has_a_first_day(landed):
    with pytest.raises(ValueError, match="archive starts"):
        payloads.weather_archive(landed("early", weather_doc()), "2021-12-31")


CSV = """utc_timestamp,cet_cest_timestamp,DE_KN_residential1_pv,DE_KN_industrial3_area_room_1
2015-01-01T00:00:00Z,2015-01-01T01:00:00+0100,1.5,10
2015-01-01T01:00:00Z,2015-01-01T02:00:00+0100,,11
2015-01-01T02:00:00Z,2015-01-01T03:00:00+0100,2.5,12
"""


def test_household_csv_becomes_long(spark, tmp_path):
    (tmp_path / "h.csv").write_text(CSV)
    wide = payloads.read_household_csv(spark, str(tmp_path / "h.csv"))
    assert len(payloads.channel_columns(wide)) == 2
    rows = payloads.household(wide).orderBy("channel", TS).collect()
    assert len(rows) == 5
    assert (rows[0]["building"], rows[0]["building_type"], rows[0]["device"]) == (
        "industrial3", "industrial", "area_room_1")
    assert [r["meter_kwh"] for r in rows] == [10.0, 11.0, 12.0, 1.5, 2.5]
    assert str(rows[3][TS]) == "2015-01-01 00:00:00"


def test_ingest_selects_tables_and_names_unknown_ones(landed, spark, tmp_path):
    docs = {"price": landed("p", {"unix_seconds": HOURS, "price": [1, 2, 3]}),
            "installed_power": landed("c", {"time": ["01.2022"], "production_types": [
                {"name": "Solar AC", "data": [1]}]})}
    target = str(tmp_path / "raw")
    made = payloads.builders(docs, start="2023-01-01")
    counts = {r["table"]: r["rows"] for r in tables.ingest(spark, made, target).collect()}
    assert counts == {"price": 3, "installed_power": 1}
    one = tables.ingest(spark, made, target, ["price"]).collect()
    assert [r["table"] for r in one] == ["price"]
    with pytest.raises(ValueError, match="no such raw tables"):
        tables.ingest(spark, made, target, ["prices"])
    late = payloads.builders(docs, start="2025-01-01")
    with pytest.raises(ValueError, match="no rows"):
        tables.ingest(spark, late, target, ["price"])


def test_replacing_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.replace_table(spark.range(5).toDF("n"), path) == 5
    assert tables.replace_table(spark.range(3).toDF("n"), path) == 3
    with pytest.raises(ValueError, match="nothing to load"):
        tables.replace_table(spark.range(0).toDF("n"), path)
    assert tables.row_count(spark, path) == 3


def test_saving_appends_and_checks_columns(spark, tmp_path, hours):
    path = str(tmp_path / "log")
    issue = hours("2026-08-02 00:00:00", 24).select(
        TS, F.lit(0.1).alias("predicted_capacity_factor"), F.to_date(TS).alias("target_date"),
        F.lit("2026-08-01 13:00:00").cast("timestamp_ntz").alias("issued_at"))
    assert tables.save_predictions(issue, path, "ridge") == 24
    assert tables.save_predictions(issue, path, "gradient_boosting") == 48
    assert "model_name" in tables.load_predictions(spark, path).columns
    with pytest.raises(KeyError, match="missing columns"):
        tables.save_predictions(issue.drop("predicted_capacity_factor"), path, "x")


def test_parameters_are_values_of_known_types(spark):
    row = tables.query(spark, "select :a + 1 as a, :b as b, :c as c, :d as d",
                       a=1, b=True, c="x'; drop", d=dt.datetime(2024, 1, 1)).collect()[0]
    assert (row["a"], row["b"], row["c"]) == (2, True, "x'; drop")
    with pytest.raises(TypeError, match="unsupported"):
        tables.query(spark, "select :a", a=[1])
    assert not tables.table_exists(spark, "no_such_table")
    assert tables.columns_like(spark.range(1).selectExpr("1 lag_1", "2 x"), "lag") == ["lag_1"]


def test_a_response_without_values_or_of_unequal_lengths_fails(spark):
    def documents(text):
        return spark.createDataFrame([("DE", text)], "zone string, payload string")

    for text, message in (
        ('{"unix_seconds": [0, 3600]}', "no price"),
        ('{"unix_seconds": [0, 3600], "price": [1.0]}', "2 instants but 1 values"),
        ('{"unix_seconds": [0], "price": [1.0, 2.0]}', "1 instants but 2 values"),
    ):
        with pytest.raises(Exception, match=message):
            payloads.price(documents(text)).collect()
    with pytest.raises(Exception, match="no forecast_values"):
        payloads.operator_forecast(documents('{"unix_seconds": [0], "production_type": "solar"}')).collect()
    series = '{"unix_seconds": [0], "production_types": [{"name": "Solar"}]}'
    with pytest.raises(Exception, match="a series has no data"):
        payloads.public_power(documents(series)).collect()


def test_loading_evaluates_its_input_once_and_keeps_the_old_table_on_failure(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = str(tmp_path / "t")
    df = spark.range(10).mapInArrow(look, "id bigint")
    assert tables.load_table(df, path) == 10 and seen.value == 10
    assert tables.load_table(spark.range(3), path, replace=False) == 3
    assert spark.read.parquet(path).count() == 13
    with pytest.raises(ValueError, match="no rows"):
        tables.load_table(spark.range(0), path)
    with pytest.raises(Exception, match="broken"):
        tables.load_table(spark.range(1).selectExpr("raise_error('broken') AS id"), path)
    assert spark.read.parquet(path).count() == 13
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
