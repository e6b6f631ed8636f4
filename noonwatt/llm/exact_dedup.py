"""Exact deduplication with a heavy-hitter split.

Texts are compared by the SHA-256 of their normalised form. A Misra-Gries pass over
the digests names the few that may be frequent; an exact aggregation verifies them and
picks their winners, which are broadcast, so rows of a frequent text never meet in a
shuffle. Every other digest has a proven small share of the rows and is grouped by an
ordinary shuffle.

Defined results: a null text counts as empty. A null ``doc_id`` loses against any other;
among rows that repeat text and ``doc_id`` exactly one stays. An empty table gives no
rows. Columns of any other name are carried through untouched by ``deduplicate``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.llm.common import ascii_lower, fresh, stored, text_or_empty

#: Counters of a Misra-Gries summary. At most COUNTERS + 1 digests are called frequent,
#: and every digest left over has under 2 / (COUNTERS + 1) of all rows.
COUNTERS = 1024


def digest(text: str = "text") -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text_or_empty(text)), 256))


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Counter:
    """A summary of one task's values: each count is short of the true one by at
    most rows / (counters + 1)."""
    seen: Counter = Counter()
    for batch in batches:
        for pair in pc.value_counts(batch.column(0)).to_pylist():
            seen[pair["values"]] += pair["counts"]
        if len(seen) > counters:
            cut = sorted(seen.values(), reverse=True)[counters]
            seen = Counter({v: n - cut for v, n in seen.items() if n > cut})
    return seen


def frequent(digests: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """(digest): every one with at least 2 rows / (counters + 1), at most counters + 1.

    Summaries of the tasks add up: the sum of their counts is short by at most
    rows / (counters + 1) in all.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = misra_gries(batches, counters)
        if seen:
            yield pa.record_batch(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["digest", "least"],
            )

    summary = digests.select("digest").mapInArrow(summarise, "digest binary, least bigint")
    return (
        summary.groupBy("digest")
        .agg(F.sum("least").alias("least"))
        .where(F.col("least") >= max(rows / (counters + 1), 2))
        .select("digest")
    )


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of the frequent digests, from exact counts."""
    named = frequent(digests, digests.count(), counters)
    verified = (
        digests.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    )
    return stored(
        verified.select(
            "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"
        ),
        "winners",
    )


def _digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, row, digest), stored: the texts are read and hashed once."""
    return stored(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            digest(text).alias("digest"),
        ),
        "digests",
    )


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs, text, doc_id)
    top = winners(digests, counters)
    hot = digests.join(F.broadcast(top), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    group = W.partitionBy("digest")
    cold = digests.join(F.broadcast(top.select("digest")), "digest", "left_anti").select(
        "*",
        F.max("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id"), F.desc("row"))) == 1).alias("kept"),
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    return hot.select(*columns).unionByName(cold.select(*columns))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns.

    Losing rows of frequent texts are removed in the map tasks; the rest is shuffled once
    by digest, after each map task has cut its own groups to one row.
    """
    top = winners(_digests(docs, text, doc_id), counters)
    key, keep, heavy, rank = fresh(docs, "digest", "keep_id", "heavy", "rank")
    known = top.select(
        F.col("digest").alias(key), F.col("keep_id").alias(keep), F.lit(True).alias(heavy)
    )
    may_stay = F.col(heavy).isNull() | F.col(f"`{doc_id}`").eqNullSafe(F.col(keep))
    order = W.partitionBy(key).orderBy(F.desc_nulls_last(f"`{doc_id}`"))
    return (
        docs.withColumn(key, digest(text))
        .join(F.broadcast(known), key, "left")
        .where(may_stay)
        .withColumn(rank, F.row_number().over(order))
        .where(F.col(rank) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
