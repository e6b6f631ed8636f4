"""Exact deduplication against a grouping by hand."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from noonwatt.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, keep_id int, rank string"
LONG = "Ab c" * 100_000
ROWS = [
    (1, "Hello", "x", 1, "r"),
    (2, "hello", "x", 2, None),
    (3, "HELLO ", "x", 3, "r"),
    (4, None, None, None, None),
    (5, "", "x", 5, "r"),
    (None, "hello", "x", 6, "r"),
    (None, "only here", "x", 7, "r"),
    (None, "only here", "x", 7, "r"),
    (6, "É", "x", 8, "r"),
    (7, "é", "x", 9, "r"),
    (8, LONG, "x", 9, "r"),
    (9, LONG.lower(), "x", 9, "r"),
    (9, LONG.lower(), "x", 9, "r"),
]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(ids, 1):
            out.append((i, ids[-1], len(ids), n == len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_like_grouping_by_hand(spark, counters):
    docs = spark.createDataFrame(ROWS * 2, SCHEMA)
    got = exact_dedup.assign(docs, counters=counters)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == expected(ROWS * 2)


@pytest.mark.parametrize("counters", [1, 1024])
def test_one_row_of_each_text_stays_with_its_columns(spark, counters):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.deduplicate(docs, counters=counters)
    assert got.columns == docs.columns
    kept = sorted((tuple(r) for r in got.collect()), key=str)
    best = {}
    for r in ROWS:
        key = lowered(r[1])
        if key not in best or (r[0] or -1) >= (best[key][0] or -1):
            best[key] = r
    assert kept == sorted(best.values(), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.assign(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0


def test_summaries_stay_within_their_bounds():
    values = [b"a"] * 500 + [b"b"] * 200 + [str(i).encode() for i in range(300)]
    batches = [pa.record_batch([pa.array(values[i::7], pa.binary())], names=["digest"]) for i in range(7)]
    true = Counter(values)
    for counters in (1, 3, 10, 2000):
        seen = exact_dedup.misra_gries(iter(batches), counters)
        assert len(seen) <= counters
        assert all(true[v] - len(values) / (counters + 1) <= n <= true[v] for v, n in seen.items())
        assert all(v in seen for v, n in true.items() if n > len(values) / (counters + 1))


def test_frequent_digests_are_few_and_all_the_frequent_ones(spark):
    values = [(b"a",)] * 300 + [(b"b",)] * 100 + [(str(i).encode(),) for i in range(600)]
    df = spark.createDataFrame(values, "digest binary").repartition(5)
    got = {bytes(r[0]) for r in exact_dedup.frequent(df, 1000, 19).collect()}
    assert {b"a", b"b"} <= got and len(got) <= 20
