"""Token counts against a segmentation of each word by hand."""

import math
import random
from pathlib import Path

import pytest

from noonwatt.llm import token_count as t
from noonwatt.llm.queries import VOCABULARY

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "abab", "é", "▁ab", "bb"]


def by_hand(word, model):
    path = "▁" + word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(path)
    for i in range(1, len(path) + 1):
        n = len(path[i - 1].encode())
        best[i] = (best[i - 1][0] + n * model.byte, best[i - 1][1] + n)
        for j in range(i):
            if path[j:i] in model.scores:
                other = (best[j][0] + model.scores[path[j:i]], best[j][1] + 1)
                if (other[0], -other[1]) > (best[i][0], -best[i][1]):
                    best[i] = other
    return best[-1][1]


def test_shared_prefixes_change_nothing():
    model, rng = t.Unigram.of(PIECES), random.Random(2)
    words = {"".join(rng.choice("abéx") for _ in range(rng.randrange(1, 12))) for _ in range(300)} | {"a" * 5000, "a" * 4999 + "b"}
    got = t.terminal_counts({w.encode() for w in words}, model)
    assert got == {w.encode(): by_hand(w, model) for w in words}


def test_documents(spark):
    model = t.Unigram.of(PIECES)
    rows = [(1, "ab  ab\nabab", 1), (2, None, 2), (3, "", 3), (4, " \t", 4), (5, "x é", 5), (5, "x é", 5), (None, "b b", 6), (7, "ab " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = sorted(map(tuple, t.count_tokens(docs, model).collect()), key=str)
    want = []
    for i, text, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        counts = {w: by_hand(w, model) for w in set(words)}
        want.append((i, len(words), sum(counts[w] for w in words)))
    assert got == sorted(want, key=str)
    assert t.count_tokens(docs.limit(0), model).count() == 0


def test_forgetting_changes_nothing(spark, monkeypatch):
    model = t.Unigram.of(PIECES)
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat_ws(' ', hex(id), 'ab', lower(hex(id * 7))) AS text")
    want = sorted(map(tuple, t.count_tokens(docs, model).collect()))
    monkeypatch.setattr(t, "KEPT", 10)
    assert sorted(map(tuple, t.count_tokens(docs, model).collect())) == want


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="vocabulary file absent")
def test_public_vocabulary():
    model = t.Unigram.load(VOCABULARY)
    assert len(model.scores) > 30_000
    assert t.terminal_counts({b"the"}, model) == {b"the": 1}
    words = {"internationalisation", "übermäßig", "日本語", "zzzzqqqq"}
    assert t.terminal_counts({w.encode() for w in words}, model) == {w.encode(): by_hand(w, model) for w in words}
