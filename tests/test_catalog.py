"""Catalog tables, buckets and joins between them."""

import pytest
from pyspark.sql import functions as F

from noonwatt.sources import catalog

TS = "utc_timestamp"


@pytest.fixture(scope="module", autouse=True)
def schema(spark):
    yield "noonwatt_test"
    catalog.drop_schema(spark, "noonwatt_test")


@pytest.fixture(scope="module")
def series(hours):
    return hours("2024-01-01 00:00:00", 24 * 70, ("A", "B", "C")).select("zone", TS, F.col("id").cast("double").alias("solar_mw"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_and_columns_are_found_by_pattern(spark, series):
    catalog.register_table(series, "noonwatt_test.stg_a")
    catalog.register_table(series.withColumn("load_mw", F.lit(1.0)), "noonwatt_test.stg_b")
    catalog.register_table(series.limit(3), "noonwatt_test.mart")
    assert catalog.table_names(spark, "stg_*", "noonwatt_test") == ["noonwatt_test.stg_a", "noonwatt_test.stg_b"]
    assert catalog.column_names(spark, "noonwatt_test.stg_b", "*_mw") == ["solar_mw", "load_mw"]
    assert catalog.column_names(spark, "noonwatt_test.stg_b") == ["zone", TS, "solar_mw", "load_mw"]
    with pytest.raises(ValueError, match="no table"):
        catalog.column_names(spark, "noonwatt_test.absent")
    got = {tuple(r) for r in catalog.describe(spark, "noonwatt_test", "stg_*").collect()}
    assert got == {("noonwatt_test.stg_a", 5040, 3), ("noonwatt_test.stg_b", 5040, 4)}
    found = {tuple(r) for r in catalog.matching_columns(spark, "noonwatt_test", "stg_b", "l*").collect()}
    assert found == {("noonwatt_test.stg_b", "load_mw", "double")}
    assert catalog.describe(spark, "noonwatt_test", "zzz").count() == 0


def test_a_second_registration_replaces_the_first(spark, series):
    catalog.register_table(series, "noonwatt_test.twice")
    assert catalog.register_table(series.limit(5), "noonwatt_test.twice").count() == 5


def test_buckets_join_without_a_shuffle(spark, series):
    a = catalog.register_bucketed(series, "noonwatt_test.left_side", buckets=4)
    b = catalog.register_bucketed(series.withColumnRenamed("solar_mw", "other"), "noonwatt_test.right_side", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left"):
            joined = a.join(b, ["zone", catalog.MONTH, TS], how)
            assert "Exchange" not in plan(joined)
            assert joined.where("solar_mw = other").count() == 5040
        plain = series.join(series.withColumnRenamed("solar_mw", "other"), ["zone", TS])
        assert "Exchange" in plan(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_mart_joins_buckets_without_shuffling_them(spark, hours):
    from noonwatt import vocab
    from noonwatt.plans import marts

    at = hours("2024-01-01 00:00:00", 24 * 50, ("A", "B"))
    solar = at.select("zone", TS, F.col(TS).alias("local_datetime"), F.col("id").cast("double").alias("solar_mw"),
                      F.lit(100.0).alias("solar_ac_mw"), (F.col("id") % 10 / 10.0).alias(vocab.TARGET))
    national = at.select("zone", TS, *[F.col("id").cast("double").alias(c) for c in vocab.WEATHER_FEATURES],
                         F.lit(9).alias("locations_reporting"))
    operators = at.select("zone", TS, F.lit(5.0).alias("solar_forecast_mw"))
    names = {"m_solar": solar, "m_national": national, "m_operators": operators}
    tables = [catalog.register_bucketed(df, f"noonwatt_test.{n}", buckets=4) for n, df in names.items()]
    joined = []

    def seen(df):
        joined.append(plan(df))
        return df

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = marts.solar_features(*tables, store=seen, buckets=[catalog.MONTH])
        assert "Exchange" not in joined[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = marts.solar_features(solar, national, operators)
    assert got.columns == want.columns
    key = lambda r: (r.zone, r[TS])
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == 2400 and [tuple(r) for r in a] == [tuple(r) for r in b]
