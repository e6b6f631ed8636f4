"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint of its word shingles; two link where at most
MAX_DISTANCE = 2 bits differ. The fingerprint is cut into two halves. Of two bits that differ,
either both lie in one half, so the other half is equal, or one lies in each, so the first
halves are one flip apart. A table of the distinct fingerprints is therefore fetched three
times: by equal first half, by equal second half, and by every first half one flip away (the
Hamming ball of radius 1, of which a pair needs only the flips from 0 to 1). Every match is
verified by its complete distance. Equal fingerprints collapse to one row first.

A half that more than BUCKET fingerprints share is not paired with itself, nor with those one flip
away: there the ball of radius 2 in the other half, or the one flip in it, is enumerated and
looked up exactly, so the work stays in proportion to the rows and no link is lost.

Linked fingerprints become classes by alternating large-star and small-star steps, each
written to the shared folder.

Defined results: null and word-free texts have fingerprint zero and link like any other. A
null ``doc_id`` belongs to a class but never names one, unless all its members are null.
Repeated rows share a class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.llm.common import fresh, small_batches, small_side, stored

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
#: Fingerprints that may share a half and still be paired with each other.
BUCKET = 256
#: Shingles whose bits are counted at once: 64 bytes each.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and space only
    if not words:
        return 0
    size = min(size, len(words))
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    hashed = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = np.fromiter(hashed, np.dtype("<u8"), min(CHUNK, n - start))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and ``more`` columns of it."""
    small_batches(docs.sparkSession)
    narrow = docs.select(
        F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t.as_py()) for t in batch.column(0)], pa.int64())
            yield pa.record_batch([marks, *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(of, f"fp bigint, {kinds}")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _halves(fps: DataFrame) -> DataFrame:
    return fps.withColumns({
        "first": F.shiftright("fp", 32).cast("int"),
        "second": F.shiftleft("fp", 32).cast("bigint"),
    }).withColumn("second", F.shiftright("second", 32).cast("int"))


def _flips(half: str, radius: int) -> Column:
    """The masks of 1 to ``radius`` flipped bits of a half, as bigint."""
    one = [1 << i for i in range(32)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    masks = one + (two if radius > 1 else [])
    return F.array(*[F.lit(m - (1 << 32) if m >> 31 else m).cast("int") for m in masks])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a != b, each pair of distinct fingerprints within MAX_DISTANCE bits once."""
    halves = stored(_halves(fps.select("fp").distinct()), "halves")
    near = lambda a, b: _distance(a, b) <= MAX_DISTANCE
    found, crowds = [], {}
    for half in ("first", "second"):
        crowd = halves.groupBy(half).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        crowd = crowds[half] = stored(crowd, f"shared_{half}")
        small = halves.join(crowd.where(F.col("n") <= bucket).select(half), half)
        other = small.select(F.col("fp").alias("b"), F.col(half).alias("h"))
        pairs = small.join(other, (F.col(half) == F.col("h")) & (F.col("fp") < F.col("b")) & near("fp", "b"))
        found.append(pairs.select(F.col("fp").alias("a"), "b"))
        large = halves.join(crowd.where(F.col("n") > bucket).select(half), half)
        # Within a crowded half the ball lies in the other half; a pair is met from both ends.
        mask = F.explode(_flips(half, 2))
        shifted = (lambda c: c.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))) if half == "first" else (lambda c: F.shiftleft(c.cast("bigint"), 32))
        probes = large.select(F.col("fp").alias("a"), mask.alias("mask")).withColumn("b", F.col("a").bitwiseXOR(shifted(F.col("mask"))))
        probes = probes.where(F.col("a") < F.col("b")).drop("mask")
        found.append(probes.join(halves.select(F.col("fp").alias("b")), "b").select("a", "b"))
    # One flip in each half: seen from the side that has a 0 there.
    ball = halves.select(F.col("fp").alias("a"), "first", F.explode(_flips("first", 1)).alias("mask"))
    ball = ball.where(F.col("first").bitwiseAND(F.col("mask")) == 0).select(
        "a", F.col("first").bitwiseOR(F.col("mask")).alias("first")
    )
    # Where many have the half that a flip leads to, the second flip is enumerated as well.
    full = crowds["first"].where(F.col("n") > bucket).select("first", F.lit(True).alias("full"))
    ball = ball.join(small_side(full, full.count()), "first", "left")
    one_each = ball.where("full IS NULL").join(halves.select(F.col("fp").alias("b"), "first"), "first").where(
        near("a", "b") & (F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit((1 << 32) - 1))) == 1)
    )
    found.append(one_each.select("a", "b"))
    low = F.col("a").bitwiseXOR(F.col("mask").cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))).bitwiseAND(F.lit((1 << 32) - 1))
    probes = ball.where("full").select("a", "first", F.explode(_flips("second", 1)).alias("mask")).select(
        "a", F.shiftleft(F.col("first").cast("bigint"), 32).bitwiseOR(low).alias("b")
    )
    found.append(probes.join(halves.select(F.col("fp").alias("b")), "b").select("a", "b"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def classes(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: root is the least node it can reach.

    Large-star: each node links its larger neighbours to the least of its neighbourhood.
    Small-star: each node links its smaller neighbours, and itself, to the least of them.
    They are repeated until nothing changes; the rounds grow as the logarithm of the nodes.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = stored(large.distinct(), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")
        edges = stored(small.distinct(), "small_star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def components(marked: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of (doc_id, fp) rows."""
    per_fp = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    linked = stored(classes(links(per_fp, bucket)), "classes")
    known = per_fp.join(linked.withColumnRenamed("node", "fp"), "fp")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("fp", "root", "component_id")
    alone = per_fp.join(linked.select(F.col("node").alias("fp")), "fp", "left_anti")
    return named.unionByName(alone.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id")))


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = stored(fingerprints(docs, text, doc_id), "marked")
    return marked.join(components(marked, bucket), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """One document of each class stays, the one with the smallest id (of repeated ids, any
    one; a null id only where all are null), with all its columns.

    Classes and winners are settled on narrow rows. The documents are shuffled once, by a
    128-bit key of id and text, and meet the winners' keys there.
    """
    k1, k2, n = fresh(docs, "k1", "k2", "n")
    ident = (F.xxhash64(f"`{doc_id}`", f"`{text}`"), F.xxhash64(f"`{text}`", f"`{doc_id}`"))
    marked = stored(fingerprints(docs, text, doc_id, {"k1": ident[0], "k2": ident[1]}), "marked")
    of_class = components(marked, bucket).withColumnRenamed("component_id", "class")
    # All of a class have its id in common; a class of null ids is known by its fingerprint.
    label = F.struct("class", F.when(F.col("class").isNull(), F.col("root")).alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("first")
    kept = marked.join(of_class, "fp").groupBy(label.alias("label")).agg(first)
    keys = kept.select(F.col("first.k1").alias(k1), F.col("first.k2").alias(k2))
    order = W.partitionBy(k1, k2).orderBy(k1)
    return (
        docs.withColumns({k1: ident[0], k2: ident[1]})
        .join(keys, [k1, k2], "left_semi")
        .withColumn(n, F.row_number().over(order))
        .where(F.col(n) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
