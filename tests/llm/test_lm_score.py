"""LM scoring against both models counted by hand."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest

from noonwatt.llm import common
from noonwatt.llm import lm_score as m

SCHEMA = "doc_id bigint, text string, is_target string, target_id int, n_words string"


def split(text):
    return ["".join(c.lower() if c.isascii() else c for c in w.decode()) for w in (text or "").encode().split()]


def by_hand(rows, targets, size):
    counts = Counter(w for _, t in rows for w in split(t) if len(w.encode()) <= m.LONGEST)
    level = lambda n: math.floor(math.log2(n) * 8)
    fit = [b for b in map(level, counts.values()) if sum(level(n) >= b for n in counts.values()) <= size]
    vocab = {w for w, n in counts.items() if n > 1 and fit and level(n) >= min(fit)}
    ids = lambda t: [w if w in vocab else None for w in split(t)]
    models = []
    for side in (rows, [r for r in rows if r[0] in targets]):
        single, pair = Counter(), Counter()
        for _, t in side:
            seq = ids(t)
            if seq:
                single.update(seq), pair.update(zip(["begin", *seq], seq)), single.update(["begin"])
        models.append((single, pair))
    often = {p for p, n in models[0][1].items() if n > 1}
    out = []
    for i, t in rows:
        seq, loss = ids(t), [0.0, 0.0]
        for a, b in zip(["begin", *seq], seq):
            for k, (single, pair) in enumerate(models):
                total = sum(n for w, n in single.items() if w != "begin")
                p = (single[b] + 1) / (total + len(vocab) + 1)
                seen = pair[a, b] if (a, b) in often else 0
                loss[k] -= math.log((seen + m.PRIOR * p) / (single[a] + m.PRIOR))
        out.append((i, len(seq), *((loss[1] / len(seq), loss[0] / len(seq), (loss[1] - loss[0]) / len(seq)) if seq else (None, None, 0.0))))
    return out


@pytest.mark.parametrize("held", [300_000, 20])
def test_like_counts_by_hand(spark, monkeypatch, held):
    monkeypatch.setattr(m, "HELD", held)
    monkeypatch.setattr(m.vocabulary, "__defaults__", (12,))
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abÉ") for _ in range(rng.choice([1, 1, 2, 3])))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a " * 30_000), (5, rows[5][1]), (None, "a b"), (204, "a " + "b" * 70 + " A")]
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(3)
    targets = [*range(0, 40), 5, None, 999]
    got = sorted(map(tuple, m.score(docs, spark.createDataFrame([(t,) for t in targets], "doc_id bigint")).collect()), key=str)
    want = sorted(by_hand(rows, set(range(40)), 12), key=str)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[4])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:2] == w[:2]
        assert g[2:4] == pytest.approx(w[2:4]) if w[1] else g[2:4] == (None, None)
        assert g[4] == pytest.approx(w[4], abs=1e-9)


def test_few_bigrams_are_kept_by_count(spark):
    rows = [("a b a b a b c d c d e f", False)] * 5
    flagged = spark.createDataFrame(rows, "text string, is_target boolean")
    vocab = {w: i for i, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f"], 2)}
    assert len(m.models(flagged, vocab, 2).bigrams) <= 2
    assert len(m.models(flagged, vocab).bigrams) == 8


def test_no_targets_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint")
    docs = spark.createDataFrame([(1, "a b", "x", 1, None)], SCHEMA)
    assert m.score(docs, none).count() == 1
    assert m.score(docs.limit(0), none).count() == 0


@pytest.mark.parametrize(("held_words", "held_bigrams"), [(4, 6), (0, 0), (1 << 16, 6), (4, 1 << 18)])
def test_no_word_or_bigram_is_lost_beyond_what_tasks_hold(spark, monkeypatch, held_words, held_bigrams):
    monkeypatch.setattr(m, "VOCABULARY", held_words)
    monkeypatch.setattr(m, "BIGRAMS", held_bigrams)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abÉ") for _ in range(rng.choice([1, 2, 3, 6])))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    rows += [(200, None), (201, " "), (5, rows[5][1]), (None, "a b"), (204, "a " + "b" * 70 + " A")]
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(3)
    got = m.score(docs, spark.createDataFrame([(t,) for t in range(40)], "doc_id bigint")).collect()
    want = by_hand(rows, set(range(40)), 1 << 40)
    key = lambda r: (str(r[0]), r[1], round(r[4], 9))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == pytest.approx(w[2:], abs=1e-9) if w[1] else g[2:] == (None, None, 0.0)


def test_a_highest_step_with_more_rows_is_split_by_count_and_word(spark):
    counted = spark.createDataFrame([(b"d", 100), (b"a", 101), (b"c", 100), (b"b", 100)], "word binary, n bigint")
    assert {bytes(r.word) for r in m.most_frequent(counted, 2).collect()} == {b"a", b"b"}


def test_more_equally_frequent_words_than_tasks_hold_are_all_known(spark):
    text = " ".join(f"w{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    p = 3 / (140_000 + 70_001)
    for r in m.score(docs, spark.createDataFrame([], "doc_id bigint")).collect():
        assert r.n_words == 70_000
        assert r.background_loss == pytest.approx(-math.log((2 + m.PRIOR * p) / (2 + m.PRIOR)))


def written(spark):
    """Sizes of the shuffle files and of the tables written between steps."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = [f for d in local for f in Path(d.getPath()).rglob("shuffle_*.data")]
    files += Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet")
    return {f: f.stat().st_size for f in files if f.is_file()}


def test_rare_words_and_bigrams_take_three_times_the_texts_at_most(spark):
    rng = random.Random(9)
    texts = [" ".join(f"{rng.randrange(150_000):05x}" for _ in range(1500)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).cache()
    targets = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "doc_id bigint")
    docs.count(), targets.count()
    before = written(spark)
    assert m.score(docs, targets).agg({"n_words": "sum"}).first()[0] == 600_000
    taken = sum(size for f, size in written(spark).items() if f not in before)
    docs.unpersist()
    assert taken < 3 * sum(map(len, texts))


def test_equal_sums_whatever_block_a_word_is_in(spark, monkeypatch):
    rows = [(i, f"a b{i % 7} c" if i % 5 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    targets = spark.createDataFrame([(i,) for i in range(20)], "doc_id bigint")
    found = []
    for held in (3, 1 << 20):
        monkeypatch.setattr(m, "HELD", held)
        found.append({r.doc_id: tuple(r)[1:] for r in m.score(docs, targets).collect()})
    assert found[0].keys() == found[1].keys() == set(range(60))
    for i, values in found[0].items():
        assert values == pytest.approx(found[1][i]) if rows[i][1] else values == found[1][i] == (0, None, None, 0.0)


def test_more_targets_than_are_broadcast_give_equal_scores(spark, monkeypatch):
    rng = random.Random(10)
    texts = [" ".join(f"{rng.randrange(50)}" for _ in range(20)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    targets = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id bigint")
    few = sorted(map(tuple, m.score(docs, targets).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(m, "MARKS", 0)
    key = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        many = sorted(map(tuple, m.score(docs, targets).collect()))
    finally:
        spark.conf.set(key, kept)
    assert [r[:2] for r in many] == [r[:2] for r in few]
    assert [x for r in many for x in r[2:]] == pytest.approx([x for r in few for x in r[2:]])
