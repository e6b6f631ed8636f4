"""The compression classifier: held-out accuracy, and its defined results."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from noonwatt.llm import quality as q


def texts(n, seed):
    rng = random.Random(seed)
    syllables = "an ber con der el for gra hin is jo ka lum".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randrange(20, 300))]
        if not good:
            at = rng.randrange(len(words) // 2)
            words[at:] = [w.upper() + "!!" for w in words[at:]]
        out.append((i, " ".join(words), int(good)))
    return out


@pytest.fixture(scope="module")
def rows():
    return texts(1200, 8)


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t, _ in rows], "doc_id bigint, text string, label string, score double, id int")
    labels = spark.createDataFrame([(i, g, 1) for i, _, g in rows], "doc_id bigint, quality int, label int")
    return docs, labels


def test_held_out_accuracy(tables, rows):
    docs, labels = tables
    model = q.fit(docs, labels, ~q.held_out())
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    held = [(got[i], g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(r.predicted == g for r, g in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r, _ in held)


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.fit(docs, other, ~q.held_out()) == q.fit(docs, labels, ~q.held_out())


def test_reruns_agree(tables):
    docs, labels = tables
    assert q.fit(docs.repartition(5), labels.repartition(3), ~q.held_out()) == q.fit(docs, labels, ~q.held_out())


def test_odd_rows(spark, tables):
    docs, labels = tables
    model = q.fit(docs, labels, ~q.held_out())
    odd = [(1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000), (None, "short"), (4, " ")]
    got = q.score(spark.createDataFrame(odd, "doc_id bigint, text string"), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1] == by_id[2] == model.share
    assert q.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("given, score", [([], 0.5), ([(1, 1), (2, 1), (None, 0), (3, 7), (4, None), (999, 1)], 1.0)])
def test_labels_that_do_not_suffice(spark, tables, given, score):
    labels = spark.createDataFrame(given, "doc_id bigint, quality int")
    model = q.fit(tables[0], labels, F.lit(True))
    assert {r.score for r in q.score(tables[0].limit(3), model).collect()} == {score}


def test_features_cover_every_block():
    d = q.Dictionaries(b"good words here " * 100, b"BAD!! WORDS!! " * 100)
    end = "good words here " * 400 + "BAD!! WORDS!! " * 36
    whole, worst = d.features(end)
    assert worst < 0 < whole
    assert d.features(None) == d.features("")


def by_hand(rows, learn, pieces=q.DICTIONARY_TEXTS, points=q.CALIBRATION_TEXTS):
    """Scores from dictionaries and a regression made here. ``rows``: (id, text, label)."""
    seed = xxhash.xxh64_intdigest(b"quality", 42)
    signed = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), seed)))[0]
    pool = sorted((signed(i), i, g, t) for i, t, g in rows if learn(i))
    first = [r for r in pool if r[0] % 2 == 0]
    content = {}
    for g in (0, 1):
        parts = []
        for order, _, _, t in [r for r in first if r[2] == g][:pieces]:
            at = (order >> 8) % (max(len(t) - q.PIECE, 0) + 1)
            parts.append(t[at : at + q.PIECE])
        content[g] = "".join(parts).encode()[: q.DICTIONARY_BYTES]

    def size(data, g):
        d = zstandard.ZstdCompressionDict(content[g], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=q.LEVEL, dict_data=d, write_content_size=False).compress(data))

    def part(data):
        good, bad = size(data, 1), size(data, 0)
        return (bad - good) / (bad + good)

    def features(t):
        data = t.encode()
        cuts = list(range(0, len(data), q.BLOCK))
        if len(cuts) > 1 and len(data) - cuts[-1] <= q.BLOCK // 2:
            cuts.pop()
        return part(data), min(part(data[a:b]) for a, b in zip(cuts, [*cuts[1:], len(data)]))

    rest = [r for r in pool if r[0] % 2][:points]
    x, y = np.array([features(r[3]) for r in rest]), np.array([r[2] for r in rest], float)
    z = np.c_[np.ones(len(x)), x / x.std(axis=0)]
    w = np.zeros(3)
    for _ in range(2000):  # the same optimum by damped Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1e-9, 1, 1]), z.T @ (y - p) - w * [0, 1, 1])
        w = w + 0.5 * step
        if np.abs(step).max() < 1e-12:
            break
    w = w / np.r_[1.0, x.std(axis=0)]
    return {i: 1 / (1 + math.exp(-(w @ [1.0, *features(t)]))) for i, t, _ in rows}


def test_scores_like_dictionaries_and_regression_by_hand(spark, tables, rows):
    docs, labels = tables
    some = rows[:400]
    few = docs.where("doc_id < 400")
    model = q.fit(few, labels.where("doc_id < 400"), ~q.held_out())
    want = by_hand(some, lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    got = {r.doc_id: r.score for r in q.score(few, model).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_ids_that_repeat_are_learnt_from_once(spark, tables, rows):
    docs, labels = tables
    few, marks = docs.where("doc_id < 300"), labels.where("doc_id < 300")
    again = few.unionByName(few.where("doc_id IN (0, 1, 2, 3)")).unionByName(few.where("doc_id = 5"))
    assert q.fit(again, marks, ~q.held_out()) == q.fit(few, marks, ~q.held_out())
