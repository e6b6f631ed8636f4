import numpy as np
import pytest
from pyspark.sql import functions as F

from noonwatt.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [20, 10000])
def test_equal_to_numpy_with_repeats_and_a_hot_key(spark, accuracy):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 11).cast("string"))
    value = F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(977)) / 8)
    df = spark.range(20000).select(
        key.alias("k"), F.when(F.col("id") % 13 != 0, value.cast("double")).alias("v")
    )
    wanted = {"p25": 0.25, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p1": 1.0}
    got = exact_quantiles(df, ["k"], "v", wanted, accuracy=accuracy).toPandas().set_index("k")
    local = df.toPandas().dropna()
    assert len(got) == local["k"].nunique()
    for k, group in local.groupby("k"):
        for name, p in wanted.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(group["v"], p), abs=1e-9)


def test_single_value(spark):
    got = exact_quantiles(spark.range(1).selectExpr("'a' k", "3.5D v"), ["k"], "v", {"p": 0.99})
    assert got.collect()[0]["p"] == 3.5


@pytest.mark.parametrize("n", range(1, 12))
def test_short_groups_and_null_keys(spark, n):
    df = spark.range(n).select(F.lit(None).cast("string").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    wanted = {f"p{p}": p / 100 for p in (0, 1, 10, 25, 33, 50, 75, 90, 99, 100)}
    row = exact_quantiles(df, ["k"], "v", wanted).collect()[0]
    for name, p in wanted.items():
        assert row[name] == pytest.approx(np.quantile([i * i for i in range(n)], p))
