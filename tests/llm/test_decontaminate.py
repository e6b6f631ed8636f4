"""Decontamination against a word-by-word search."""

import hashlib
import re
from collections import Counter

import pytest

from noonwatt.llm import decontaminate as d

A = "the quick brown fox jumps over the lazy dog near seven old barns"
SHORT = "Éclair, au chocolat!"
ITEMS = [(1, A), (2, A.upper()), (30, SHORT), (4, None), (5, "... !"), (None, "one two three four five six seven eight nine ten"), (1, A)]
DOCS = [
    (1, f"Intro. {A} outro", "a", 1),
    (2, "the quick brown fox jumps over the lazy cat", "b", 2),
    (3, "An ÉCLAIR au chocolat; an Éclair--au chocolat", None, 3),
    (4, None, "d", 4),
    (5, "", "e", 5),
    (6, "!!!", "f", 6),
    (6, "!!!", "f", 6),
    (None, "x one two three four five six seven eight nine ten y", "g", 7),
    (8, "Words " * 30_000 + A + " words" * 10, "h", 8),
    (9, "one two three four five six seven eight nine eleven", "i", 9),
]
SCHEMA = "doc_id bigint, text string, items string, pos int"


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(docs, items, length=10):
    wins = [(i, tuple(w[s : s + n])) for i, t in items if (w := words(t)) for n in [min(length, len(w))] for s in range(len(w) - n + 1)]
    out = []
    for doc in docs:
        w, hit, names = words(doc[1]), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    names.add(i)
        listed = sorted(str(i) for i in names - {None})
        out.append((doc[0], len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("block", [500_000, 2])
def test_like_a_search_by_hand(docs, items, block):
    got = d.report(docs, items, block_windows=block)
    assert Counter(map(tuple, got.collect())) == expected(DOCS, ITEMS)


def test_contaminated_documents_are_dropped(docs, items):
    got = d.drop_documents(docs, items)
    assert got.columns == docs.columns
    assert sorted((r.pos for r in got.collect())) == [2, 4, 5, 6, 6, 9]


def test_spans_are_cut(docs, items):
    got = {r.pos: r.text for r in d.cut_spans(docs, items).collect()}
    assert got[1] == "Intro.  outro"
    assert got[3] == "An ; an "
    assert got[7] == "x  y"
    assert got[8] == "Words " * 30_000 + " words" * 10
    assert {k: got[k] for k in (2, 4, 5, 6, 9)} == {p: t for _, t, _, p in DOCS if p in (2, 4, 5, 6, 9)}


def test_empty_tables(spark, docs, items):
    none = spark.createDataFrame([], SCHEMA)
    assert d.report(none, items).count() == 0
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in d.report(docs, no_items).collect())
    assert d.drop_documents(docs, no_items).count() == len(DOCS)
