"""Near-duplicates by wide fingerprints: against all pairs by hand, and measured recall."""

import random

import numpy as np
import pytest

from noonwatt.llm import simhash_near as near

SCHEMA = "doc_id bigint, text string, k1 string, n int, node string"


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


WORDS = [f"w{i}" for i in range(3000)]


def corpus(seed, n=300, copies=300):
    """Texts and edited copies of some of them; the pairs of similarity 0.8 or more."""
    rng = random.Random(seed)
    texts = [rng.choices(WORDS, k=rng.randint(60, 400)) for _ in range(n)]
    made = [(i, edited(rng, texts[i % n], rng.choice([0.005, 0.01, 0.02]))) for i in range(copies)]
    all_texts = [" ".join(t) for t in texts] + [" ".join(t) for _, t in made]
    pairs = [(i % n, n + k) for k, (i, _) in enumerate(made) if jaccard(all_texts[i % n], all_texts[n + k]) >= 0.8]
    return all_texts, pairs


def groups(df):
    return {r.doc_id: r.node for r in df.collect()}


def test_recall_of_pairs_of_the_wanted_similarity(spark):
    texts, pairs = corpus(1)
    assert len(pairs) > 150
    docs = spark.createDataFrame([(i, t, "x", 1, "n") for i, t in enumerate(texts)], SCHEMA)
    of = groups(near.assign(docs))
    assert sum(of[a] == of[b] for a, b in pairs) >= 0.95 * len(pairs)
    # Nothing else is linked: texts differ in most shingles.
    together = {}
    for i, node in of.items():
        together.setdefault(node, []).append(i)
    for members in together.values():
        assert len({i % 300 for i in members}) == 1


def test_pairs_near_the_border_are_decided_by_similarity(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(100):
        t = rng.choices(WORDS, k=300)
        for swapped in (3, 30):  # similarity about 0.9 and about 0.35
            other = list(t)
            for k in range(swapped):
                other[k * (300 // swapped)] = "other"
            texts += [" ".join(t), " ".join(other)]
    docs = spark.createDataFrame([(i, t, "x", 1, "n") for i, t in enumerate(texts)], SCHEMA)
    of = groups(near.assign(docs))
    close = sum(of[i] == of[i + 1] for i in range(0, 400, 4))
    far = sum(of[i] == of[i + 1] for i in range(2, 400, 4))
    assert close >= 97 and far == 0


@pytest.mark.parametrize("bucket", [2, 256])
def test_one_large_group_of_near_copies(spark, bucket):
    rng = random.Random(2)
    base = rng.choices(WORDS, k=200)
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 0.004)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 1, "n") for i, t in enumerate(texts)], SCHEMA)
    close = [i for i, t in enumerate(texts) if jaccard(texts[0], t) >= 0.8]
    of = groups(near.assign(docs, bucket=bucket))
    assert sum(of[i] == of[0] for i in close) >= 0.99 * len(close)
    assert near.deduplicate(docs, bucket=bucket).count() <= 1 + len(texts) - 0.99 * len(close)


def test_the_smallest_id_stays_with_its_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "x", 1, "a"), (3, text.upper(), "y", 2, "b"), (9, "quite another text of some words here", "z", 3, "c"),
            (None, text, "n", 4, "d"), (7, None, "e", 5, "e"), (8, "", "f", 6, "f"), (3, text.upper(), "y", 2, "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted([rows[1], rows[2], rows[4]])


def test_null_ids_only_where_there_is_no_other(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "x", 1, "n"), (None, "a b c d e f", "x", 1, "n")], SCHEMA)
    assert [r.doc_id for r in near.deduplicate(docs).collect()] == [None]


def test_an_empty_table_and_a_long_text(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near.deduplicate(docs).count() == 0
    long = " ".join(random.Random(3).choices(WORDS, k=200_000))
    docs = spark.createDataFrame([(1, long, "x", 1, "n"), (2, long + " more words at the end", "x", 1, "n")], SCHEMA)
    assert [r.doc_id for r in near.deduplicate(docs).collect()] == [1]


def test_fingerprints_by_hand():
    import xxhash

    text = "A b c D e f g h"
    layout = near.tables(10)
    hashes = [xxhash.xxh64_intdigest(b" ".join(s)) for s in shingles(text)]
    want = []
    for lane in range(layout.lanes):
        value = 0
        spread = [int(near._spread(np.array([h], np.uint64), lane)[0]) for h in hashes]
        for bit in range(64):
            if 2 * sum(h >> bit & 1 for h in spread) > len(hashes):
                value |= 1 << bit
        want.append(value)
    assert near.fingerprint(text, layout.lanes).view(np.uint64).tolist() == want
    assert near.fingerprint(text + " g h".replace(" g h", ""), layout.lanes).view(np.uint64).tolist() == want
    assert not near.fingerprint(" \t\n", 3).any()


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_shards_meet_every_pair_one_flip_apart(bucket):
    """All pairs of fingerprints whose value in some segment is at most one flip apart, by hand."""
    rng = np.random.default_rng(bucket)
    layout = near.Tables(bits=12, segments=4, leading=4, limit=64, sketch_limit=64)
    prints = rng.integers(0, 1 << 62, (300, 1))
    prints[:40] ^= 0  # all different; half of them share their first segment
    prints[::2] = (prints[::2] >> 12 << 12) | 5
    values = np.stack(list(near._values(prints, layout)), 1)
    want = set()
    for i in range(len(prints)):
        for j in range(i):
            apart = np.bitwise_count((values[i] ^ values[j]).astype(np.uint64))
            if (apart <= 1).any():
                want.add((j, i))
    low = layout.bits - layout.leading
    rows = {}
    for s in range(layout.segments):
        for i, v in enumerate(values[:, s]):
            rows.setdefault((s, v >> low), []).append((v, i, True))
            for bit in range(low, layout.bits):
                if not v >> bit & 1:
                    other = v | 1 << bit
                    rows.setdefault((s, other >> low), []).append((other, i, False))
    found, trees = set(), set()
    for part in rows.values():
        value, node, home = (np.array(c) for c in zip(*part))
        args = value.astype(np.int64), node, prints[node, 0], home, layout, bucket
        here = set()
        for pairs in near.shard_pairs(*args):
            here |= {(int(min(p)), int(max(p))) for p in pairs.T if p[0] != p[1]}
        edges = {(int(a), int(b)) for a, b in near.shard_forest(*args).T}
        assert edges <= here and len(edges) < max(len(set(node.tolist())), 1)
        assert _classes(edges, len(prints)) == _classes(here, len(prints))
        found |= here
        trees |= edges
    assert found <= want
    assert _classes(trees, len(prints)) == _classes(want, len(prints))
    if bucket == 1000:
        assert found == want
    else:  # crowds are chained: the same classes
        assert _classes(found, len(prints)) == _classes(want, len(prints))


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_shards_lose_no_link_of_crowds(bucket):
    """Crowds of values one flip apart, most of whose members are not near: the classes of all
    pairs that meet and whose complete distance is within the limit, by hand."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        layout = near.Tables(bits=12, segments=1, leading=0, limit=30, sketch_limit=8)
        # Chains of steps of 25 of 128 bits, all in the second word or all in the first one; 12 bits are the value.
        steps = np.zeros((40, 2), np.uint64)
        for i in range(40):
            lane = i % 2
            steps[i, lane] = sum(1 << int(b) for b in rng.choice(np.arange(12, 64), 25, replace=False))
        prints = rng.integers(0, 1 << 62, (8, 1, 2)).astype(np.uint64) ^ np.bitwise_xor.accumulate(steps)[None]
        prints = prints.reshape(-1, 2)
        prints[:, 0] = prints[:, 0] >> np.uint64(12) << np.uint64(12) | rng.choice([0, 1, 2, 64], len(prints)).astype(np.uint64)
        prints = rng.permutation(prints).view(np.int64)
        value = prints[:, 0] & 4095
        node, home = np.arange(len(prints)), rng.random(len(prints)) < 0.8
        want = []
        for i in range(len(prints)):
            for j in range(i):
                flips = int(value[i] ^ value[j]).bit_count()
                met = flips <= 1 and home[i] and home[j] or flips == 0 and home[i] != home[j]
                apart = sum(int(x).bit_count() for x in (prints[i] ^ prints[j]).view(np.uint64))
                if met and apart <= layout.limit:
                    want.append((j, i))
        assert len(want) > 20
        edges = near.shard_forest(value, node, prints, home, layout, bucket)
        edges = {(int(a), int(b)) for a, b in edges.T}
        assert edges <= set(want)
        assert _classes(edges, len(prints)) == _classes(want, len(prints))


def _classes(pairs, n):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_a_forest_takes_the_closest_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(2, 40)
        pairs = np.sort(rng.integers(0, n, (2, 3 * n)), axis=0)
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
        distance = rng.integers(0, 5, pairs.shape[1])
        got, far = near.forest(pairs, distance)
        order = sorted(zip(distance.tolist(), *pairs.tolist()))
        want, root = [], list(range(n))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for d, a, b in order:
            if top(a) != top(b):
                root[top(a)] = top(b)
                want.append((d, a, b))
        assert sorted(zip(far.tolist(), *got.tolist())) == want


def test_the_layout_follows_the_number_of_rows():
    small, large = near.tables(50_000), near.tables(15_000_000)
    assert (small.bits, large.bits) == (18, 26)
    assert small.segments < large.segments
    p = near.differing(0.8)
    for layout in (small, large):
        met = (1 - p) ** layout.bits + layout.bits * p * (1 - p) ** (layout.bits - 1)
        assert (1 - met) ** layout.segments <= near.MISSED
