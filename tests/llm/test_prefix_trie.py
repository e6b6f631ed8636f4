"""Prefix trie against one built by hand."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from noonwatt.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, key string"


def conversations(rows):
    """conv_id -> turns, ordered by number (null first), then by the digest of their contents."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out.setdefault(conv, []).append(((turn is not None, turn or 0), mark, role, text))
    return {c: [t[2:] for t in sorted(said)] for c, said in out.items()}


def expected(said):
    members, ends = {}, {}
    for conv, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        listed = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(1 for p in members if p and p[:-1] == path), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(listed.encode()).hexdigest(),
        ))
    return Counter(out)


def made(seed, n=60, ids=None):
    random.seed(seed)
    rows = []
    for c in ids or range(n):
        for t in range(random.choice([0, 1, 2, 3, 6])):
            text = random.choice(["hi", "Ünicode 🙂", "", None, "bye"]) if t < 2 else random.choice("ab") * t
            rows.append((c, random.choice([t, t, None]), random.choice(["user", None]), text, 1, "k"))
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("sizes", [{}, {"task_turns": 20, "shard": 3}, {"task_turns": 1000, "shard": 1}])
def test_like_a_trie_by_hand(spark, sizes):
    rows = made(1) + [(None, 0, "user", "of no one", 1, "k"), (7, None, None, None, None, None), (7, None, None, None, None, None)]
    got = prefix_trie.trie(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)), **sizes)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == expected(conversations(rows))


@pytest.mark.parametrize("seed", [2, 3])
def test_branched_like_the_contract_by_hand(spark, seed):
    ids = [*range(190, 215), 300, 301, 405, 99, 100, -3, -105, -200, 10**15 + 7]
    rows = made(seed, ids=ids)
    own = conversations(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    df = queries._branched(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)))
    got = prefix_trie.trie(df, task_turns=25, shard=4)
    assert Counter(map(tuple, got.collect())) == expected(rebuilt)


def test_no_conversation_has_no_node(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.turns(empty)).count() == 0
    assert prefix_trie.trie(queries._branched(prefix_trie.turns(empty))).count() == 0


def test_equal_conversations_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t}", 1, "k") for c in range(50) for t in range(3)]
    got = prefix_trie.trie(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)), task_turns=10, shard=2)
    assert Counter(map(tuple, got.collect())) == expected(conversations(rows))


def test_a_very_long_conversation_and_a_long_text(spark):
    rows = [(1, t, "user", "x", 1, "k") for t in range(3000)] + [(2, 0, "user", "y" * 300_000, 1, "k")]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got) == 3002
    assert got[1, 0].n_leaves == 2 and got[1, 0].saved_tokens == 0
    assert got[1, 3000].n_children == 0 and got[1, 3000].parent_conv_id == 1


def test_the_role_counts_and_where_it_ends(spark):
    rows = [(1, 0, "ab", "c", 1, "k"), (2, 0, "a", "bc", 1, "k"), (3, 0, "ab", "c", 1, "k")]
    got = prefix_trie.trie(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)))
    assert Counter(map(tuple, got.collect())) == expected(conversations(rows))
