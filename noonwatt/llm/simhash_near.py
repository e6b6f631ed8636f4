"""Near-duplicates of a wanted similarity by wide SimHash fingerprints.

``simhash`` links 64-bit fingerprints within 2 bits, which only nearly unedited copies are. A
similarity of 0.8 of the five-word shingles makes 15 % of all bits differ, so here the
fingerprint is wider and cut into more segments: a segment has two bits more than the
number of fingerprints needs, and there are so many that a pair of just the wanted similarity
misses all of them in one of twenty cases. Each segment's table is fetched at the
fingerprint's own value and at every value one flip away (of a pair, only the flips from 0 to 1).
What is fetched is compared by the complete distance at once: the fingerprints travel whole.

A table is dealt into shards by the leading bits of its values. Flips of the other bits stay in
the shard, so a fingerprint sends one row to its own shard and one to the shards of its leading
flips, not one for each of its flips.

Classes need no more than a spanning forest of the links, so a shard passes on just that. What
leaves it is bounded by its rows, however large a group of near copies is, and every pair that
meets and is near stays joined. Of more than BUCKET fingerprints of one value, or of two values
one flip apart with more pairs than that, what is reached is followed: each fingerprint that is
joined is compared with those that nothing has reached yet. A group of near copies is so taken
in a few comparisons of each; only what is not near is compared with all others.

Distances of a fingerprint of B bits estimate the share of differing bits within
sqrt(0.13 / B), less than two hundredths at the least width of 512 bits; the limit lies one such
error beyond the wanted similarity.

Defined results: null and word-free texts have the fingerprint zero and are near copies of each
other. Fewer words than a shingle's are one shingle; repeated shingles count once. Of each class
the smallest id stays (of repeated ids, any one; a null id only where all are null). An empty table
gives no rows. All columns are carried through.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.llm.common import fresh, small_batches, stored
from noonwatt.llm.simhash import classes

SHINGLE = 5
SIMILARITY = 0.8
#: Least 64-bit words of a fingerprint, for the complete distance to be exact enough.
LANES = 8
#: Share of pairs of just the wanted similarity that all segments may miss.
MISSED = 0.05
#: Fingerprints of one segment value that are all compared with each other.
BUCKET = 64
#: Shingles whose bits are counted at once, and pairs that are compared, or held, at once.
CHUNK, PAIRS = 1 << 14, 1 << 20
#: Rows that a shard may hold, some 100 bytes each.
SHARD_BITS = 17


@dataclass(frozen=True)
class Tables:
    """Segments of ``bits`` bits each, ``leading`` of which name the shard. Near pairs differ in
    ``limit`` bits at most, and in ``sketch_limit`` of the first 64 but for one in some
    hundreds: an estimate by which no pair is dropped."""

    bits: int
    segments: int
    leading: int
    limit: int
    sketch_limit: int

    @property
    def lanes(self) -> int:
        return _lanes(self.bits, self.segments)


def _lanes(bits: int, segments: int) -> int:
    return max(LANES, -(-bits * segments // 64))


def differing(similarity: float) -> float:
    """Share of differing bits of two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(rows: int, similarity: float = SIMILARITY, missed: float = MISSED) -> Tables:
    """The layout for so many fingerprints: the same rule at every size."""
    p, size = differing(similarity), max(rows, 1).bit_length()
    bits = max(12, size + 2)
    met = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    segments = math.ceil(math.log(missed) / math.log(1 - met))
    whole = 64 * _lanes(bits, segments)
    limit = lambda width, errors: math.floor(width * p + errors * math.sqrt(width * p * (1 - p)))
    return Tables(bits, segments, max(3, size - SHARD_BITS), limit(whole, 1), limit(64, 3))


def _spread(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each shingle."""
    x = (hashes + np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str | None, lanes: int, size: int = SHINGLE) -> np.ndarray:
    """Majority bits of the distinct shingles, as ``lanes`` signed 64-bit numbers."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(lanes, np.int64)
    size = min(size, len(words))
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(words) - size + 1))
    ones = np.zeros(64 * lanes, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK]
        wide = np.stack([_spread(part, lane) for lane in range(lanes)], 1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def _values(prints: np.ndarray, layout: Tables) -> Iterator[np.ndarray]:
    """The value of every fingerprint in each segment."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    powers = np.int64(1) << np.arange(layout.bits, dtype=np.int64)
    for s in range(layout.segments):
        yield bits[:, s * layout.bits : (s + 1) * layout.bits].astype(np.int64) @ powers


def _table_rows(nodes: DataFrame, layout: Tables) -> DataFrame:
    """(shard, value, node, fp, home): each fingerprint in its own shard of every segment,
    and in the shards one leading flip away."""
    low = layout.bits - layout.leading

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            prints = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(len(node), layout.lanes))
            for s, value in enumerate(_values(prints, layout)):
                parts = [(value, np.arange(len(node)), True)]
                for i in range(low, layout.bits):
                    at = np.flatnonzero(value >> i & 1 == 0)
                    parts.append((value[at] | np.int64(1) << i, at, False))
                made = np.concatenate([p[0] for p in parts])
                at = np.concatenate([p[1] for p in parts])
                home = np.concatenate([np.full(len(p[1]), p[2]) for p in parts])
                offsets = np.arange(0, (len(at) + 1) * layout.lanes, layout.lanes, dtype=np.int32)
                yield pa.record_batch(
                    [pa.array(made >> low | np.int64(s) << layout.leading), pa.array(made), pa.array(node[at]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(prints[at].ravel())), pa.array(home)],
                    names=["shard", "value", "node", "fp", "home"],
                )

    return nodes.select("node", "fp").mapInArrow(deal, "shard bigint, value bigint, node bigint, fp array<bigint>, home boolean")


def _near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of fingerprints differ in ``limit`` bits at most."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64) <= limit


def _near_at(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """The same of the rows ``i`` of a and ``j`` of b, word by word to hold less."""
    apart = np.zeros(len(i), np.int64)
    for lane in range(a.shape[1]):
        apart += np.bitwise_count((a[i, lane] ^ b[j, lane]).view(np.uint64))
    return apart <= limit


def _met(asking: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, home: tuple[np.ndarray, np.ndarray, np.ndarray],
         limit: int, bucket: int) -> Iterator[np.ndarray]:
    """Near pairs of those that ask for a value and those at home there; where these are many,
    enough of them to join what all of them join."""
    order = np.argsort(wanted, kind="stable")
    wanted, asks, prints = wanted[order], asking[0][order], asking[1][order]
    values, nodes, at_home = home
    left = np.searchsorted(values, wanted, "left")
    n = np.searchsorted(values, wanted, "right") - left
    starts = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]])) if len(wanted) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(wanted)]]))
    many = sizes * n[starts] > bucket * bucket
    for a, size in zip(starts[many], sizes[many]):
        b, m = left[a], n[a]
        for i, j in _across(prints[a : a + size], at_home[b : b + m], limit):
            yield np.stack([asks[a + i], nodes[b + j]])
    n[np.repeat(many, sizes)] = 0
    some = np.flatnonzero(n)
    edges = np.searchsorted(np.cumsum(n[some]), np.arange(0, n.sum() + PAIRS, PAIRS))
    for a, b in zip(edges[:-1], edges[1:]):
        at = some[a : b + 1] if b < len(some) else some[a:]
        who = np.repeat(at, n[at])
        other = np.arange(len(who)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + left[who]
        good = _near_at(prints, who, at_home, other, limit)
        yield np.stack([asks[who[good]], nodes[other[good]]])


def _across(a: np.ndarray, b: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (rows of a, rows of b) that join all that near pairs of a row of a and one of b join."""
    sides, left = (a, b), [np.arange(len(a)), np.arange(len(b))]
    rest = [a, b]
    while len(left[0]) and len(left[1]):
        reached = deque([(0, left[0][0])])
        left[0], rest[0] = left[0][1:], rest[0][1:]
        while reached and (len(left[0]) or len(left[1])):
            side, row = reached.popleft()
            other = 1 - side
            if not len(left[other]):
                continue
            good = _near(rest[other], sides[side][row], limit)
            if good.any():
                new = left[other][good]
                one = np.full(len(new), row)
                yield (one, new) if side == 0 else (new, one)
                reached.extend((other, x) for x in new)
                left[other], rest[other] = left[other][~good], rest[other][~good]


def _crowd(nodes: np.ndarray, prints: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Near pairs that join all that the near pairs of these fingerprints join."""
    left, rest = np.arange(len(nodes)), prints
    while len(left):
        reached = deque([left[0]])
        left, rest = left[1:], rest[1:]
        while reached and len(left):
            row = reached.popleft()
            good = _near(rest, prints[row], limit)
            if good.any():
                new = left[good]
                yield np.stack([np.full(len(new), nodes[row]), nodes[new]])
                reached.extend(new)
                left, rest = left[~good], rest[~good]


def shard_pairs(value: np.ndarray, node: np.ndarray, prints: np.ndarray, home: np.ndarray, layout: Tables,
                bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """Near pairs of nodes of one shard whose values are at most one flip apart: all of them, or
    of crowds enough to join the same nodes. ``prints`` has a row of words for each node."""
    prints = prints.reshape(len(node), -1)
    order = np.lexsort((node[home], value[home]))
    here = tuple(x[home][order] for x in (value, node, prints))
    values, nodes, at_home = here
    limit = layout.limit
    # Equal values.
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(values)]]))
    size = np.repeat(sizes, sizes)
    for k in range(1, int(min(sizes.max(initial=0), bucket))):
        at = np.flatnonzero((values[k:] == values[:-k]) & (size[k:] <= bucket))
        good = _near_at(at_home, at, at_home, at + k, limit)
        yield np.stack([nodes[at[good]], nodes[at[good] + k]])
    for start, n in zip(starts[sizes > bucket], sizes[sizes > bucket]):
        yield from _crowd(nodes[start : start + n], at_home[start : start + n], limit)
    # One flip of a bit that does not change the shard, and one that has brought a row here.
    for i in range(layout.bits - layout.leading):
        at = np.flatnonzero(values >> i & 1 == 0)
        yield from _met((nodes[at], at_home[at]), values[at] | np.int64(1) << i, here, limit, bucket)
    yield from _met((node[~home], prints[~home]), value[~home], here, limit, bucket)


def forest(pairs: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest pairs that join all that the pairs join, ties by the pair, and their distances.

    Each tree takes its closest pair to another one, until no pair joins two trees.
    """
    order = np.lexsort((pairs[1], pairs[0], distance))
    pairs, distance = pairs[:, order], distance[order]
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(pairs.shape)
    tree, taken = np.arange(len(nodes)), np.zeros(len(distance), bool)
    while True:
        a, b = tree[ends]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return pairs[:, taken], distance[taken]
        best = np.full(len(nodes), len(distance))
        np.minimum.at(best, a[apart], apart)
        np.minimum.at(best, b[apart], apart)
        trees = np.flatnonzero(best < len(distance))
        chosen = best[trees]
        taken[chosen] = True
        other = np.where(a[chosen] == trees, b[chosen], a[chosen])
        onto = np.arange(len(nodes))
        onto[trees] = other
        mutual = trees[(onto[other] == trees) & (trees < other)]
        onto[mutual] = mutual
        while (onto[onto] != onto).any():
            onto = onto[onto]
        tree = onto[tree]


def shard_forest(value: np.ndarray, node: np.ndarray, prints: np.ndarray, home: np.ndarray, layout: Tables,
                 bucket: int = BUCKET) -> np.ndarray:
    """A forest of a shard's near pairs, gathered a bounded number at a time. All pairs are
    links already, so any forest joins the same nodes."""
    held, waiting, n = np.zeros((2, 0), np.int64), [], 0

    def joined() -> np.ndarray:
        every = np.concatenate([held, *waiting], axis=1)
        every = np.sort(every[:, every[0] != every[1]], axis=0)
        return forest(every, np.zeros(every.shape[1], np.int64))[0] if every.shape[1] else every

    for found in shard_pairs(value, node, prints, home, layout, bucket):
        waiting.append(found)
        n += found.shape[1]
        if n > PAIRS:
            held, waiting, n = joined(), [], 0
    return joined()


def links(nodes: DataFrame, layout: Tables, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: the pairs of the shards' forests. ``nodes``: (node, fp), distinct fingerprints."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting = None, []

        def done() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([w[i] for w in waiting]) for i in range(4)]
            a, b = shard_forest(*columns, layout, bucket)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            shard, value, node, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "value", "node", "home"))
            columns = value, node, batch.column("fp").flatten().to_numpy().reshape(len(node), -1), home
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if waiting and shard[a] != current:
                    yield from done()
                    waiting = []
                current = shard[a]
                waiting.append([c[a:b] for c in columns])
        if waiting:
            yield from done()

    n = layout.segments << layout.leading
    dealt = _table_rows(nodes, layout).repartition(n, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(match, "a bigint, b bigint").distinct()


def marked(docs: DataFrame, layout: Tables, text: str, doc_id: str, size: int) -> DataFrame:
    """(doc_id, k1, k2, fp) of every row; the keys are a 128-bit digest of id and text."""
    small_batches(docs.sparkSession)
    narrow = docs.select(
        F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("k1"),
        F.xxhash64(f"`{text}`", f"`{doc_id}`").alias("k2"),
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.concatenate([fingerprint(t.as_py(), layout.lanes, size) for t in batch.column(0)])
            offsets = np.arange(0, len(prints) + 1, layout.lanes, dtype=np.int32)
            wide = pa.ListArray.from_arrays(pa.array(offsets), pa.array(prints))
            yield pa.record_batch([*batch.columns[1:], wide], names=[*batch.schema.names[1:], "fp"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(of, f"doc_id {kind}, k1 bigint, k2 bigint, fp array<bigint>")


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE,
           similarity: float = SIMILARITY, missed: float = MISSED, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, k1, k2, node) of every row: rows of one node are near copies of each other."""
    rows = docs.count()
    layout = tables(rows, similarity, missed)
    prints = stored(marked(docs, layout, text, doc_id, size), "marked")
    nodes = stored(prints.select("fp").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    linked = stored(classes(links(nodes, layout, bucket)), "classes")
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("root", "node").alias("node"))
    return prints.join(named, "fp").drop("fp")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class of near copies, with all its columns.

    Classes and winners are settled on narrow rows; the documents meet the winners' keys in one
    shuffle.
    """
    k1, k2, n = fresh(docs, "k1", "k2", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("first")
    kept = assign(docs, text, doc_id, **options).groupBy("node").agg(first)
    keys = kept.select(F.col("first.k1").alias(k1), F.col("first.k2").alias(k2))
    marks = {k1: F.xxhash64(f"`{doc_id}`", f"`{text}`"), k2: F.xxhash64(f"`{text}`", f"`{doc_id}`")}
    order = W.partitionBy(k1, k2).orderBy(k1)
    return (
        docs.withColumns(marks)
        .join(keys, [k1, k2], "left_semi")
        .withColumn(n, F.row_number().over(order))
        .where(F.col(n) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
