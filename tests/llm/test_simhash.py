"""SimHash near-duplicates against all pairs by hand."""

import random
import re

import pytest
import xxhash

from noonwatt.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, k1 int, n string"


def by_hand(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def close(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1") <= 2


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(25):
        words = [rng.choice("alpha beta gamma delta eps Zeta eta theta É".split()) for _ in range(rng.randrange(1, 120))]
        out.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(["omega", "psi"])
            out.append("\n".join(words))
    return [*out, None, "", " \t", " ", "One", "one two", "ONE  TWO", "word " * 150_000]


def test_like_all_pairs_by_hand(spark, texts):
    ids = list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in zip(ids, texts)], SCHEMA)
    mark = dict(zip(ids, map(by_hand, texts)))
    want = classes([(a, b) for a in ids for b in ids if a < b and close(mark[a], mark[b])], ids)
    for bucket in (simhash.BUCKET, 1):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.assign(docs, bucket=bucket).collect()}
        assert got == {i: (f"{mark[i]:016x}", want[i]) for i in ids}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_of_crowded_and_sparse_halves(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    marks = set(base)
    for b in base:
        for _ in range(40):
            marks.add(b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    fps = spark.createDataFrame([(m,) for m in signed], "fp bigint")
    want = {(a, b) for a in signed for b in signed if a < b and close(a, b)}
    for bucket in (1, 3, 10_000):
        rows = [tuple(sorted(r)) for r in simhash.links(fps, bucket).select("a", "b").collect()]
        assert set(rows) == want


def test_classes_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 200), (150, 300), (300, 301)]
    rng = random.Random(1)
    pairs = [p if rng.random() < 0.5 else p[::-1] for p in pairs]
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.root for r in simhash.classes(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == classes(pairs, nodes)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a b c", "x", 1, None), (None, "a b c", "x", 1, None), (5, "x y z", "x", 1, None), (5, "x y z", "x", 1, None), (None, "x y z", "x", 2, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.assign(docs).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (5, 5), (5, 5), (None, 5)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect()), key=str)
    assert kept == [(5, "x y z"), (None, "a b c")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.assign(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0


def test_two_crowds_whose_halves_are_one_flip_apart(spark):
    rng = random.Random(9)
    first = rng.getrandbits(32) & ~1
    low = list({rng.getrandbits(32) for _ in range(3000)})
    marks = [(first << 32) | x for x in low] + [((first | 1) << 32) | (x ^ 1 << rng.randrange(32)) for x in low[:500]]
    marks += [((first | 1) << 32) | rng.getrandbits(32) for _ in range(2000)]
    known = set(marks)
    want = set()
    for m in known:
        for i in range(64):
            for j in range(i + 1):
                other = m ^ 1 << i ^ (1 << j if j < i else 0)
                if other in known and other > m:
                    want.add((m, other))
    fps = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in known], "fp bigint")
    unsigned = lambda v: v & (1 << 64) - 1
    got = {tuple(sorted(map(unsigned, r))) for r in simhash.links(fps).select("a", "b").collect()}
    assert got == want and len(want) >= 500
