"""Tables in the session's catalog: registered, bucketed, and asked about by name."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonwatt.functions.calendar import month_start
from noonwatt.session import shared_folder

TS = "utc_timestamp"
MONTH = "utc_month"


def register_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as the catalog's table ``schema.name`` and return the table; an older one of
    that name is replaced. Its files lie at ``path``, by default in a new shared folder."""
    spark = df.sparkSession
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name.split('.')[0]}`")
    at = path or os.path.join(shared_folder(spark), name.replace(".", "_"))
    df.write.mode("overwrite").option("path", at).saveAsTable(name)
    return spark.table(name)


def register_bucketed(
    df: DataFrame, name: str, keys: Sequence[str] = ("zone",), buckets: int = 32, order: str = TS,
    path: str | None = None,
) -> DataFrame:
    """A catalog table in buckets of (keys, month), sorted by time inside, with the column ``utc_month``.

    Tables bucketed alike join on those columns and any others without being shuffled:
    a month of a key is in one bucket of each. A key's months spread over the buckets, so
    one large key is no large bucket.
    """
    spark = df.sparkSession
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name.split('.')[0]}`")
    at = path or os.path.join(shared_folder(spark), name.replace(".", "_"))
    placed = df.withColumn(MONTH, month_start(order)).repartition(buckets, *keys, MONTH)
    placed.write.mode("overwrite").bucketBy(buckets, *keys, MONTH).sortBy(order).option("path", at).saveAsTable(name)
    return bucketed(spark, name)


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    """A bucketed table, in a session that joins buckets on more columns than their own
    without a shuffle."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(name)


def table_names(spark: SparkSession, pattern: str = "*", schema: str | None = None) -> list[str]:
    """Names of tables and views like ``pattern`` (``*`` and ``?``), sorted; with their schema
    where they have one."""
    found = spark.catalog.listTables(schema) if schema else spark.catalog.listTables()
    names = [".".join([*(t.namespace or []), t.name]) for t in found]
    return sorted(n for n in names if fnmatch.fnmatchcase(n.rsplit(".", 1)[-1], pattern))


def column_names(spark: SparkSession, table: str, pattern: str = "*") -> list[str]:
    """Columns of a table like ``pattern``, in the table's order. An unknown table fails."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"no table or view {table}")
    return [c.name for c in spark.catalog.listColumns(table) if fnmatch.fnmatchcase(c.name, pattern)]


def describe(spark: SparkSession, schema: str, pattern: str = "*") -> DataFrame:
    """(table, rows, columns) of a schema's tables like ``pattern``; rows come from file footers."""
    names = table_names(spark, pattern, schema)
    if not names:
        return spark.createDataFrame([], "table string, rows bigint, columns bigint")
    out = None
    for name in names:
        counted = spark.table(name).agg(F.count(F.lit(1)).alias("rows"))
        width = len(column_names(spark, name))
        row = counted.select(F.lit(name).alias("table"), "rows", F.lit(width).cast("bigint").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def matching_columns(spark: SparkSession, schema: str, tables: str, columns: str) -> DataFrame:
    """(table, column, type) of the columns like ``columns`` of the tables like ``tables``."""
    rows = []
    for name in table_names(spark, tables, schema):
        kinds = {c.name: c.dataType for c in spark.catalog.listColumns(name)}
        rows += [(name, c, kinds[c]) for c in column_names(spark, name, columns)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def drop_schema(spark: SparkSession, schema: str) -> None:
    """Forget a schema and its tables; files at paths of their own stay."""
    spark.sql(f"DROP SCHEMA IF EXISTS `{schema}` CASCADE")
