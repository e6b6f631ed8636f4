import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from noonwatt.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hours(spark):
    """``hours(start, n, zones)``: n consecutive UTC hours per zone."""
    from pyspark.sql import functions as F

    def make(start: str, n: int, zones=("A",)):
        at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))
        zone = F.explode(F.array(*[F.lit(z) for z in zones])).alias("zone")
        return spark.range(n).select(zone, "id", at.alias("utc_timestamp"))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """``table(rows, schema)`` where timestamps are given as text."""

    def make(rows, schema):
        names = [c.strip().split(" ", 1) for c in schema.split(",")]
        text = ", ".join(f"{n} {'string' if t == 'timestamp_ntz' else t}" for n, t in names)
        df = spark.createDataFrame(rows, text)
        for n, t in names:
            if t == "timestamp_ntz":
                df = df.withColumn(n, df[n].cast("timestamp_ntz"))
        return df

    return make


def partitions_read(df):
    """Partitions that each scan of a plan without exchanges has read."""
    done = df._jdf.queryExecution()
    done.toRdd().count()
    leaves = done.executedPlan().collectLeaves()
    return [leaves.apply(i).metrics().apply("numPartitions").value() for i in range(leaves.size())]


def same(got, want, keys, tolerance=1e-9):
    """Compare two DataFrames row by row on ``keys``."""
    a = got.toPandas().sort_values(list(keys)).reset_index(drop=True)
    b = want.toPandas().sort_values(list(keys)).reset_index(drop=True)
    assert len(a) == len(b)
    for c in b.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            x, y = x.astype(float), y.astype(float)
            assert (x.isna() == y.isna()).all(), c
            assert ((x - y).abs().fillna(0) <= tolerance).all(), c
        else:
            assert (x.isna() == y.isna()).all(), c
            assert (x[x.notna()] == y[y.notna()]).all(), c
