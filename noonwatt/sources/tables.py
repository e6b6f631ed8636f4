"""Writing and reading tables, the prediction log, named-parameter queries."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from noonwatt.operators.quality import require_columns
from noonwatt.session import shared_folder

TS = "utc_timestamp"
LOG_COLUMNS = ("utc_timestamp", "predicted_capacity_factor", "target_date")


def write_table(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write to a new shared folder and read it back: lineage ends at files that
    outlive executors."""
    path = os.path.join(shared_folder(spark), name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``, and a maker of its paths."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the table at ``fresh`` in the place of the one at ``path``."""
    files, at = _filesystem(spark, path)
    old = f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
    if files.exists(at(path)) and not files.rename(at(path), at(old)):
        raise OSError(f"cannot move the old table at {path} aside")
    if not files.rename(at(fresh), at(path)):
        if files.exists(at(old)):
            files.rename(at(old), at(path))
        raise OSError(f"cannot move the new table to {path}")
    files.delete(at(old), True)


def _join(spark: SparkSession, fresh: str, path: str) -> None:
    """Move the files of the table at ``fresh`` into the one at ``path``. Their names are their
    own, so none is replaced."""
    files, at = _filesystem(spark, fresh)
    root = files.makeQualified(at(fresh)).toString()
    found = files.listFiles(at(fresh), True)
    while found.hasNext():
        file = found.next().getPath()
        if not file.getName().startswith("part-"):
            continue
        to = at(path.rstrip("/") + file.toString()[len(root) :])
        files.mkdirs(to.getParent())
        if not files.rename(file, to):
            raise OSError(f"cannot move {file} to {to}")


def load_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), replace: bool = True
) -> int:
    """Load ``df`` into the table at ``path`` and return the rows loaded.

    The input is evaluated once. It is written beside the table and takes its place, or
    joins it with ``replace=False``, only when the write has succeeded and brought rows.
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    counted, seen = _counted(df)
    files, at = _filesystem(spark, path)
    try:
        counted.write.partitionBy(*partition_by).parquet(fresh)
        rows = seen.get["rows"]
        if rows == 0:
            raise ValueError(f"nothing to load into {path}: the frame has no rows")
        if replace or not files.exists(at(path)):
            _swap(spark, fresh, path)
        else:
            _join(spark, fresh, path)
    finally:
        files.delete(at(fresh), True)
    return rows


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Replace a table; a reload gives the same rows. Refuses to load nothing."""
    return load_table(df, path, partition_by)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a table, from the file footers."""
    return spark.read.parquet(path).count()


def save_predictions(prediction: DataFrame, path: str, model_name: str) -> int:
    """Append a forecast; earlier issues for the same day stay. Returns all rows."""
    require_columns(prediction, LOG_COLUMNS, "prediction")
    record = prediction.withColumns(
        {"model_name": F.lit(model_name), "target_date": F.to_date("target_date")}
    )
    load_table(record, path, ["target_date"], replace=False)
    return row_count(prediction.sparkSession, path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Every saved forecast, newest issue first."""
    return spark.read.parquet(path).orderBy(F.desc("issued_at"), TS)


def read_ordered(spark: SparkSession, path: str, by: Sequence[str] = (TS,)) -> DataFrame:
    return spark.read.parquet(path).orderBy(*by)


def ingest(
    spark: SparkSession,
    builders: dict[str, Callable[[], DataFrame]],
    target: str,
    tables: Sequence[str] | None = None,
) -> DataFrame:
    """Build and load the named raw tables; (table, rows) per table."""
    selected = list(tables or builders)
    unknown = sorted(set(selected) - set(builders))
    if unknown:
        raise ValueError(f"no such raw tables: {unknown}; there are {sorted(builders)}")
    rows = [(name, load_table(builders[name](), os.path.join(target, name))) for name in selected]
    return spark.createDataFrame(rows, "table string, rows bigint")


_PARAMETER_TYPES = (bool, int, float, str, dt.datetime)


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """Run SQL with named parameters; values never become SQL text."""
    for name, value in parameters.items():
        if not isinstance(value, _PARAMETER_TYPES):
            raise TypeError(f"parameter {name!r} is of the unsupported type {type(value).__name__}")
    return spark.sql(sql, args=parameters)


def describe_catalog(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """Rows and columns of tables or views as the catalog knows them; ``names``: label -> name.
    A name that is not there fails."""
    parts = []
    for label, name in names.items():
        if not table_exists(spark, name):
            raise ValueError(f"no table or view {name}")
        columns = len(spark.catalog.listColumns(name))
        counted = spark.table(name).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(counted.select(F.lit(label).alias("table"), "rows", F.lit(columns).cast("bigint").alias("columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Column names that contain ``pattern``."""
    return [c for c in df.columns if pattern in c]


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
