"""Text rules, row numbers and stored tables that the operators share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noonwatt.sources.tables import write_table

#: Rows of a side that may be broadcast once they are counted. A row is at most
#: some hundred bytes, so the side stays under a few tens of MB.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is.

    ``lower`` does just that on pure ASCII and is much faster there; elsewhere it
    would also change letters like É.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"{stem}_{uuid.uuid4().hex[:8]}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows``: a task then holds a few MB of
    them, whatever the length of the documents. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the cluster's shared folder and read back: evaluated once, and
    its lineage ends at files that outlive executors."""
    return write_table(df, df.sparkSession, name)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast only where its counted rows stay in bounds.
    Beyond, Spark joins by shuffle and adaptive execution splits hot keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
