"""Phrase collocations by counting quotient filters.

Words become seeded hashes. A dictionary pass counts all words and verifies that no two share
an id, at the narrowest width at which that holds; if even the widest fails, the seed changes.
Ids are therefore lossless, and every task computes them by itself.

An n-gram is a packed tuple of ids. An invertible permutation spreads it over its bits: the
leading bits are the quotient, the others, all of them, the remainder, so a filter can be
read back to exact n-grams. A task sorts what it has met into such filters, one for each shard (a
range of quotients), with runs in unary, remainders in whole bytes and counters in a byte with an
escape. Filters of one shard are merged in sorted order, one shard after the other. Each gram is
one entry of a task's filter however often it occurs, and shards are even by the permutation.

A phrase is only as frequent as its parts. Words and shorter grams of sufficient count set bits
in a map of MARK_BITS bits; grams with an unset part are not gathered. A full map would
cost time, never results.

Defined results: a null text is empty, a null language is ``und``. Repeated rows all count.
Phrases do not cross pieces or documents. Texts of any length are read in slices. Ties in score
and count go by the phrase's UTF-8 bytes. An empty table gives no rows. Extra columns do not
matter.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.llm.common import small_batches, small_side, stored, text_or_empty

LONGEST = 3
LEAST = 10
#: Bits of a map of frequent parts: 8 MB.
MARK_BITS = 26
#: Words that a task gathers before it writes its filters, and that a shard may expect.
TASK_WORDS = 3_000_000
SHARD_WORDS = 2_000_000
#: More shards would cut a task's filters into crumbs.
MOST_SHARDS = TASK_WORDS // 16
#: Distinct words that a task remembers, and bytes of text that it splits at once.
MEMORY = 300_000
SLICE = 4_000_000
WIDEST = 63
SEEDS = 8

#: Everything that ends a piece becomes a full stop, which is in no word.
_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, and ``.`` at the ends of pieces, in slices of a long text."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > SLICE:
            gap = _GAP.search(text, start + SLICE)
            end = gap.start() if gap else end
        yield text[start:end].lower().translate(_STOPS).replace(b".", b" . ").split()
        start = end


_ALL = (1 << 64) - 1


def _hash(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"%d:%b%b" % (len(lang), lang, word), seed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _mix_one(x: int) -> int:
    """``_mix`` of one number; numpy is slow on single ones."""
    x = x * 0x9E3779B97F4A7C15 & _ALL
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _ALL
    return x ^ (x >> 29)


def _round(lanes: list[np.ndarray], i: int, turn: int, width: int) -> np.ndarray:
    """What is added to lane ``i``: it depends on the other lanes only."""
    rest = [_mix(x + np.uint64(j + 1)) * np.uint64(2 * j + 3) for j, x in enumerate(lanes) if j != i]
    total = reduce(np.add, rest, np.full(len(lanes[i]), np.uint64(turn + 1)))
    return _mix(total) >> np.uint64(64 - width)


def permute(lanes: list[np.ndarray], width: int, back: bool = False) -> list[np.ndarray]:
    """A bijection of tuples of ``width``-bit lanes, and its inverse."""
    lanes = list(lanes)
    steps = [(turn, i) for turn in range(2) for i in range(len(lanes))]
    for turn, i in reversed(steps) if back else steps:
        lanes[i] = lanes[i] ^ _round(lanes, i, turn, width)
    return lanes


def marks_of(permuted: list[np.ndarray]) -> np.ndarray:
    """The bit of each gram in the map."""
    return _mix(reduce(np.bitwise_xor, permuted)) >> np.uint64(64 - MARK_BITS)


def merged(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct tuples and their sums. The first lane alone nearly always orders them."""
    if not len(counts):
        return lanes, counts
    for order in (lambda: np.argsort(lanes[0]), lambda: np.lexsort(lanes[::-1])):
        at = order()
        placed = [x[at] for x in lanes]
        first, *others = [x[1:] == x[:-1] for x in placed]
        same = reduce(and_, others, first)
        if not (first & ~same).any():
            break
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    return [x[starts] for x in placed], np.add.reduceat(counts[at], starts)


def _least_bytes(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _from_bytes(data: memoryview, n: int, bits: int) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    width = -(-bits // 8)
    whole[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return whole.view("<u8").reshape(n).astype(np.uint64)


_HEAD = "<QBQ"


def packed(lanes: list[np.ndarray], counts: np.ndarray, width: int, shard_bits: int) -> bytes:
    """A counting quotient filter of one shard's sorted distinct tuples."""
    n = len(counts)
    quotient_bits = min(int(n).bit_length(), width - shard_bits)
    rest_bits = width - shard_bits - quotient_bits
    inside = lanes[0] & np.uint64((1 << (width - shard_bits)) - 1)
    quotient = (inside >> np.uint64(rest_bits)).astype(np.int64)
    # Each quotient's run in ones, closed by a zero.
    runs = np.zeros((1 << quotient_bits) + n, np.uint8)
    runs[quotient + np.arange(n)] = 1
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255]
    parts = [
        struct.pack(_HEAD, n, quotient_bits, len(large)),
        np.packbits(runs).tobytes(),
        _least_bytes(inside & np.uint64((1 << rest_bits) - 1), rest_bits),
        *[_least_bytes(x, width) for x in lanes[1:]],
        small.tobytes(),
        large.astype("<i8").tobytes(),
    ]
    return b"".join(parts)


def unpacked(data: bytes, shard: int, length: int, width: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The tuples and counts of a filter."""
    n, quotient_bits, n_large = struct.unpack_from(_HEAD, data)
    rest_bits = width - shard_bits - quotient_bits
    view, at = memoryview(data), struct.calcsize(_HEAD)

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size : at]

    runs = np.unpackbits(np.frombuffer(take(-(-((1 << quotient_bits) + n) // 8)), np.uint8))
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
    rest = _from_bytes(take(n * -(-rest_bits // 8)), n, rest_bits)
    others = [_from_bytes(take(n * -(-width // 8)), n, width) for _ in range(length - 1)]
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(take(8 * n_large), "<i8")
    first = (np.uint64(shard) << np.uint64(width - shard_bits)) | (quotient << np.uint64(rest_bits)) | rest
    return [first, *others], counts


def _spoken(docs: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        text_or_empty(text).cast("binary").alias("text"),
    )


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, n) of all words. ``rows``: (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def full() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                words.pop(b".", None)
                spoken, names = lang.encode(), list(words)
                hashed = np.array([_hash(spoken, w, seed) for w in names], np.uint64).view(np.int64)
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                        pa.array(hashed), pa.array(list(words.values()), pa.int64()),
                    ],
                    names=["lang", "word", "hash", "n"],
                )
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = seen.setdefault(lang, Counter())
                for part in tokens(text.as_py()):
                    words.update(part)
            if sum(map(len, seen.values())) > MEMORY:
                yield from full()
        yield from full()

    found = rows.mapInArrow(count, "lang string, word string, hash bigint, n bigint")
    return found.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def _id(width: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - width)


def dictionary(rows: DataFrame, widest: int = WIDEST) -> tuple[DataFrame, int, int]:
    """(lang, word, id, n) of all words, the seed and the width of their ids: no two words share
    one and none is zero."""
    for seed in range(SEEDS):
        words = stored(count_words(rows, seed), "words")
        n = words.count()
        width = min(widest, 2 * max(n, 2).bit_length() + 6)
        while True:
            ids = words.select(_id(width).alias("id"))
            if ids.where("id > 0").distinct().count() == n:
                return words.select("lang", "word", _id(width).alias("id"), "n"), seed, width
            if width == widest:
                break
            width = min(widest, width + 8)
    raise RuntimeError(f"two words share an id under each of {SEEDS} seeds")


def mark_map(marks: DataFrame) -> np.ndarray:
    """The map whose bits ``mark`` are set: 2 ** (MARK_BITS - 6) rows at most."""
    words = marks.groupBy(F.shiftright("mark", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(mark & 63 as int)))").alias("bits")
    )
    found = words.toArrow()  # as columns: a million row objects would fill the driver
    out = np.zeros(1 << (MARK_BITS - 6), np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def marked(where: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return (where[(marks >> np.uint64(6)).astype(np.int64)] >> (marks & np.uint64(63))) & np.uint64(1) == 1


class _Ids(dict):
    """Word -> id of one language; 0 where the word is too rare or ends a piece."""

    def __init__(self, lang: str, seed: int, width: int, frequent: np.ndarray):
        super().__init__({b".": 0})
        self.lang, self.seed, self.width, self.frequent = lang.encode(), seed, width, frequent

    def __missing__(self, word: bytes) -> int:
        number = _hash(self.lang, word, self.seed) >> (64 - self.width)
        mark = _mix_one(number) >> (64 - MARK_BITS)
        self[word] = number = number if (int(self.frequent[mark >> 6]) >> (mark & 63)) & 1 else 0
        return number


def count_grams(rows: DataFrame, length: int, seed: int, width: int, words: np.ndarray,
                shorter: np.ndarray | None, n_words: int, least: int,
                task_words: int = TASK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(w0, w1, ..., n, mark) of the grams of ``length`` ids that occur ``least`` times.

    ``words`` and ``shorter`` are the maps of words and of grams one word shorter.
    """
    shards = min(max(8, math.ceil(n_words / shard_words)), MOST_SHARDS)
    shard_bits = min((shards - 1).bit_length(), width - 1)
    context = rows.sparkSession.sparkContext
    held = context.broadcast((words, shorter))

    def filters(ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        n = len(ids) - length + 1
        if n <= 0:
            return
        at = np.flatnonzero(reduce(and_, [ids[i : i + n] != 0 for i in range(length)]))
        if shorter is not None:
            for start in (0, 1):
                part = permute([ids[at + start + i] for i in range(length - 1)], width)
                at = at[marked(held.value[1], marks_of(part))]
        if not len(at):
            return
        lanes, counts = merged(permute([ids[at + i] for i in range(length)], width), np.ones(len(at), np.int64))
        shard = (lanes[0] >> np.uint64(width - shard_bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(shard[a]), packed([x[a:b] for x in lanes], counts[a:b], width, shard_bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, _Ids] = {}
        kept: list[np.ndarray] = []
        size = 0
        gap = np.zeros(1, np.uint64)

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal size
            ids = np.concatenate(kept) if kept else gap
            found = list(filters(ids))
            # A gram may go on in the next part of a long text.
            kept[:] = [ids[-(length - 1) :]]
            size = 0
            for start in range(0, len(found), 64):
                part = found[start : start + 64]
                yield pa.record_batch(
                    [pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.binary())],
                    names=["shard", "filter"],
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in memo:
                    memo[lang] = _Ids(lang, seed, width, held.value[0])
                known = memo[lang]
                for part in tokens(text.as_py()):
                    kept.append(np.fromiter(map(known.__getitem__, part), np.uint64, len(part)))
                    size += len(part)
                    if size >= task_words:
                        yield from full()
                    if len(known) > MEMORY:
                        known.clear()
                        known[b"."] = 0
                kept.append(gap)
            if sum(map(len, memo.values())) > MEMORY:
                memo.clear()
        yield from full()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, entries = None, [], 0

        def joined() -> tuple[list[np.ndarray], np.ndarray]:
            lanes = [np.concatenate([w[0][i] for w in waiting]) for i in range(length)]
            return merged(lanes, np.concatenate([w[1] for w in waiting]))

        def done() -> pa.RecordBatch:
            lanes, counts = joined()
            often = counts >= least
            lanes, counts = [x[often] for x in lanes], counts[often]
            ids = permute(lanes, width, back=True)
            columns = [*[x.view(np.int64) for x in ids], counts, marks_of(lanes).view(np.int64)]
            return pa.record_batch([pa.array(c) for c in columns], names=[*_words(length), "n", "mark"])

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != current:
                    if waiting:
                        yield done()
                    current, waiting, entries = shard, [], 0
                waiting.append(unpacked(data.as_py(), shard, length, width, shard_bits))
                entries += len(waiting[-1][1])
                if entries > 2 * len(waiting[0][1]) + SHARD_WORDS:
                    waiting = [joined()]
                    entries = len(waiting[0][1])
        if waiting:
            yield done()

    made = rows.mapInArrow(gather, "shard bigint, filter binary")
    dealt = made.repartition(1 << shard_bits, "shard").sortWithinPartitions("shard")
    schema = ", ".join(f"{w} bigint" for w in _words(length)) + ", n bigint, mark bigint"
    return dealt.mapInArrow(merge, schema)


def _words(length: int, start: int = 0) -> list[str]:
    return [f"w{i}" for i in range(start, start + length)]


def _part(table: DataFrame, length: int, start: int, name: str) -> DataFrame:
    """Counts of grams keyed by the ids of positions ``start`` on of a longer one."""
    return table.select(*[F.col(a).alias(b) for a, b in zip(_words(length), _words(length, start))], F.col("n").alias(name))


def _score(l: str, r: str) -> Column:  # noqa: E741
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    square = (wide("a") * wide("a")) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square, wide(l) * wide(r))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 inside_percent: int = 50, top: int = 2000, widest: int = WIDEST, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    rows = _spoken(docs, text, lang)
    words, seed, width = dictionary(rows, widest)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    totals = stored(totals, "totals")
    n_words = totals.agg(F.sum("n")).head()[0] or 0
    known = stored(words.where(F.col("n") >= least), "frequent_words")
    n_known = known.count()
    named = small_side(known.select(F.col("id").alias("w0"), "lang", "word"), n_known)
    counts = {1: small_side(known.select(F.col("id").alias("w0"), "n"), n_known)}

    maps = {1: mark_map(_marks_of_words(known))}
    for k in range(2, longest + 1):
        found = count_grams(rows, k, seed, width, maps[1], maps.get(k - 1) if k > 2 else None, n_words, least, **sizes)
        counts[k] = stored(found, f"grams{k}")
        if k < longest:
            maps[k] = mark_map(counts[k].select("mark"))

    parts = []
    for k in range(2, longest + 1):
        one = counts[k].select(*_words(k), F.col("n").alias("a"))
        for cut in range(1, k):
            for size, start, name in ((cut, 0, f"l{cut}"), (k - cut, cut, f"r{cut}")):
                one = one.join(_part(counts[size], size, start, name), _words(size, start))
        cuts = F.array(*[
            F.struct(_score(f"l{c}", f"r{c}").alias("score"), F.lit(c).alias("cut"),
                     F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))
            for c in range(1, k)
        ])
        # Structs compare by score, then by cut.
        one = one.withColumn("best", F.array_min(cuts))
        around = _within(counts, k, longest)
        if around is not None:
            one = one.join(around, _words(k), "left").where(
                F.coalesce(100 * F.col("around") < inside_percent * F.col("a"), F.lit(True))
            )
        for i in range(k):
            spoken = named.select(F.col("w0").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *(["lang"] if i == 0 else []))
            one = one.join(spoken, f"w{i}")
        parts.append(one.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(k)]).alias("phrase"), "a", "best.*"))

    every = reduce(DataFrame.unionByName, parts)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The bare row number: map tasks then keep the best of their own rows only.
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _within(counts: dict[int, DataFrame], k: int, longest: int) -> DataFrame | None:
    """Of each gram of ``k`` words the highest count of a longer one around it."""
    found = [
        counts[m].select(*[F.col(f"w{start + i}").alias(f"w{i}") for i in range(k)], "n")
        for m in range(k + 1, longest + 1)
        for start in range(m - k + 1)
    ]
    if not found:
        return None
    return reduce(DataFrame.unionByName, found).groupBy(*_words(k)).agg(F.max("n").alias("around"))


def _marks_of_words(known: DataFrame) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.record_batch([pa.array(marks_of([ids]).view(np.int64))], names=["mark"])

    return known.select("id").mapInArrow(mark, "mark bigint")
