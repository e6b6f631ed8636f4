"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Benchmark texts become windows of words; their hashes are broadcast. Every window of
every document probes that set inside one scan, and each hit is verified word by word.
Documents, or only the hit spans, are then removed.

The set is broadcast in blocks of at most BLOCK_WINDOWS windows, one pass per block, so
what an executor holds is bounded however long the benchmark is.

Defined results: null and word-free texts have no words, match nothing and stay. Repeated
documents are judged one by one; repeated items count once. A null item id still marks
words, but is in no list of items. Empty tables give no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt.llm.common import ascii_lower, fresh, small_side, stored, text_or_empty

WINDOW = 10
#: A window is some 100 bytes with its words, so a block is about 50 MB.
BLOCK_WINDOWS = 500_000

_OUTSIDE = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{_OUTSIDE}]+"
#: The same words in a text that is not lower-cased, and what lies between them.
_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, text: str = "text", item_id: str = "item_id", length: int = WINDOW) -> DataFrame:
    """(len, key, window, items): each distinct window with the items that have it."""
    split = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(text).alias("words"))
    span = F.least(F.size("words"), F.lit(length))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)
    return (
        split.where(F.size("words") > 0)
        .withColumn("len", span)
        .withColumn("start", F.explode(starts))
        .groupBy("len", F.slice("words", F.col("start"), F.col("len")).alias("window"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("key", F.xxhash64("window"))
    )


def _hits(docs: DataFrame, found: DataFrame, lengths: list[int], text: str) -> DataFrame:
    """(row, doc_id, n_words, pos, len, items): one row per document with len 0, and one
    per verified window."""
    split = docs.withColumn("words", words(text))
    each = split.withColumn("len", F.explode(F.array(*[F.lit(n) for n in [0, *lengths]])))
    starts = F.when(F.col("len") == 0, F.array(F.lit(0))).when(
        F.size("words") >= F.col("len"), F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)
    )
    here = F.slice("words", F.greatest("pos", F.lit(1)), F.col("len"))
    # A start of 0 is no window: it stands for the document itself.
    at = each.withColumn("pos", F.explode(starts)).withColumn(
        "key", F.when(F.col("pos") > 0, F.xxhash64(here))
    )
    b = found.select(F.col("key").alias("b_key"), "window", "items")
    verified = (F.col("key") == F.col("b_key")) & (here == F.col("window"))
    return (
        at.join(F.broadcast(b), verified, "left")
        .where((F.col("pos") == 0) | F.col("items").isNotNull())
        .select("row", "doc_id", F.size("words").cast("bigint").alias("n_words"), "pos", "len", "items")
    )


def scan(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
         item_text: str = "text", item_id: str = "item_id", length: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, row, n_words, hit_words (positions from 1), items."""
    found = stored(windows(items, item_text, item_id, length), "windows")
    lengths = sorted(r[0] for r in found.select("len").distinct().collect())  # at most ``length``
    blocks = max(1, -(-found.count() // block_windows))
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
    )
    if blocks > 1:
        narrow = stored(narrow, "numbered")  # the passes must agree on row numbers
    block = F.pmod(F.hash("window"), F.lit(blocks))
    hits = reduce(
        DataFrame.unionByName,
        [_hits(narrow, found.where(block == b) if blocks > 1 else found, lengths, "text") for b in range(blocks)],
    )
    covered = F.transform(
        F.col("hits"), lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - F.lit(1))
    )
    return (
        hits.groupBy("row", "doc_id", "n_words")
        .agg(
            F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "len"))).alias("hits"),
            F.collect_set("items").alias("items"),
        )
        .select(
            "doc_id",
            "row",
            "n_words",
            F.array_distinct(F.flatten(covered)).alias("hit_words"),
            F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs, items, **options).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def _hit_texts(docs: DataFrame, items: DataFrame, text: str, options: dict) -> tuple[DataFrame, int]:
    """(digest, hit_words) of the contaminated texts, and their number. Whether a text is
    contaminated depends on the text alone, so its digest is the key: ids may be null."""
    digest = F.unhex(F.sha2(text_or_empty(text), 256))
    texts = docs.select(digest.alias("digest"), F.col(f"`{text}`").alias("text"))
    hit = scan(texts, items, doc_id="digest", **options).where(F.size("hit_words") > 0)
    found = stored(hit.groupBy("doc_id").agg(F.max("hit_words").alias("hit_words")), "hit_texts")
    return found.withColumnRenamed("doc_id", "digest"), found.count()


def drop_documents(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found, rows = _hit_texts(docs, items, text, options)
    (key,) = fresh(docs, "digest")
    hit = found.select(F.col("digest").alias(key))
    clean = docs.withColumn(key, F.unhex(F.sha2(text_or_empty(text), 256)))
    return clean.join(small_side(hit, rows), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; hit words, and what lies between two of them, are cut out."""
    found, rows = _hit_texts(docs, items, text, options)
    key, hit, pieces, first = fresh(docs, "digest", "hit_words", "pieces", "first")
    known = found.select(F.col("digest").alias(key), F.col("hit_words").alias(hit))
    split = (
        docs.withColumn(key, F.unhex(F.sha2(text_or_empty(text), 256)))
        .join(small_side(known, rows), key, "left")
        .withColumn(pieces, F.when(F.col(hit).isNotNull(), F.regexp_extract_all(text_or_empty(text), F.lit(f"({_PIECE})"), F.lit(1))))
        # 1 where the first piece is a word: then word k is piece 2k - 1, else piece 2k.
        .withColumn(first, F.get(pieces, F.lit(0)).rlike(f"^{WORD}|^[A-Z]").cast("int"))
    )

    def stays(piece: Column, i: Column) -> Column:
        k = (i + F.lit(1) + F.col(first)) / 2  # the word, or the gap after word k - 0.5
        left, right = F.floor(k).cast("int"), F.ceil(k).cast("int")
        return ~(F.array_contains(hit, left) & F.array_contains(hit, right))

    kept = F.array_join(F.filter(F.col(pieces), stays), "")
    out = F.when(F.col(hit).isNull(), F.col(f"`{text}`")).otherwise(kept)
    return split.withColumn(text, out).select(*[F.col(f"`{c}`") for c in docs.columns])
