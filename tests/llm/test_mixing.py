"""Mixing: targets, flows and the documents taken."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noonwatt.llm import mixing as m


def reshared(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        share, left = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += share * weight[s]
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_like_sharing_again(seed):
    rng = random.Random(seed)
    sizes = {(None if i == 0 else f"s{i}é"): int(rng.random() ** 4 * 10_000) for i in range(rng.randrange(1, 12))}
    got, want = m.targets(sizes), reshared(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def cost(flow, supply):
    out = 0
    for p, given in flow.items():
        left = sum(given.values())
        for c in m.ROUND_COSTS:
            part = min(left, supply[p])
            out, left = out + c * part, left - part
        assert left == 0
    return out


def brute(supply, quota):
    """Greatest flow and its least cost, by adding one cheapest augmenting word at a time."""
    edges = []
    for p, n in supply.items():
        edges += [["S", ("p", p), n, c] for c in m.ROUND_COSTS]
        edges += [[("p", p), ("s", s), 10**6, 0] for s in p]
    edges += [[("s", s), "T", n, 0] for s, n in quota.items()]
    edges += [[b, a, 0, -c] for a, b, _, c in edges]
    half, flow, total = len(edges) // 2, 0, 0
    while True:
        far, via = {"S": 0}, {}
        for _ in range(len(supply) + len(quota) + 3):
            for i, (a, b, n, c) in enumerate(edges):
                if n and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], via[b] = far[a] + c, i
        if "T" not in far:
            return flow, total
        v = "T"
        while v != "S":
            i = via[v]
            edges[i][2] -= 1
            edges[(i + half) % (2 * half)][2] += 1
            v = edges[i][0]
        flow, total = flow + 1, total + far["T"]


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_greatest_and_cheapest(seed):
    rng = random.Random(seed)
    names = "abcd"[: rng.randrange(1, 5)]
    supply = {tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)))): rng.randrange(0, 20) for _ in range(5)}
    quota = {s: rng.randrange(0, 60) for s in names}
    flow = m.route(supply, quota)
    into = defaultdict(int)
    for p, given in flow.items():
        assert sum(given.values()) <= 3 * supply[p]
        for s, n in given.items():
            assert s in p and n >= 0
            into[s] += n
    assert all(into[s] <= quota[s] for s in into)
    assert (sum(into.values()), cost(flow, supply)) == brute(supply, quota)


SCHEMA = "doc_id bigint, text string, source string, size string, taken int, key string"


def documents(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice([None, "a", "a", "a", "a", "b", "é", "z"])
        words = " \t".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((rng.choice([i, None]), words if rng.random() < 0.9 else None, source, "x", 1, None))
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


def test_sources_come_to_their_targets(spark):
    docs = documents(spark)
    got = m.report(docs).collect()
    again = m.report(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == docs.count()
    sizes, taken, target = {}, defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.target, r.source_size] += r.taken
    for (goal, _), n in taken.items():
        assert abs(n - goal) <= 0.5
    per = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("n")).collect()}
    assert sorted(m.targets(per).values()) == sorted(t for t, _ in taken)


def test_documents_of_the_mix(spark):
    docs = documents(spark)
    got = m.mix(docs, F.array("source"))
    extra = [c for c in got.columns if c not in docs.columns]
    assert got.columns[: len(docs.columns)] == docs.columns and len(extra) == 2
    rows = got.select(*[F.col(f"`{c}`") for c in extra]).collect()
    assert sum(r[1] for r in rows) == sum(r.taken for r in m.report(docs).collect())
    assert all(0 < r[1] <= 3 * r[0] for r in rows)


def test_overlapping_sources(spark):
    rows = [(i, "one two three", ["a"] if i % 3 else ["a", "b", "b"]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, of array<string>")
    got = m.mix(docs, F.col("of"))
    taken = got.groupBy((F.size("of") > 1).alias("both")).agg(F.sum("taken").alias("n")).collect()
    goal = m.targets({"a": 270, "b": 90})
    assert abs(sum(r.n for r in taken) - sum(goal.values())) <= 1
    assert {r.both: r.n for r in taken}[True] >= int(goal["b"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert m.report(docs).count() == 0
    assert m.mix(docs, F.array("source")).count() == 0
    blank = spark.createDataFrame([(1, None, "a", "x", 1, None), (2, " ", None, "x", 1, None)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in m.report(blank).collect()] == [(0, 0, 0.0)] * 2


def test_a_hundred_thousand_sources_of_their_own_need_no_flow():
    rng = random.Random(4)
    sizes = {f"s{i}": rng.randrange(0, 1000) for i in range(100_000)}
    quota = {s: int(t + 0.5) for s, t in m.targets(sizes).items()}
    got = m.given({(s,): n for s, n in sizes.items()}, quota)
    assert all(got[(s,)] == min(q, 3 * sizes[s]) for s, q in quota.items())


@pytest.mark.parametrize("seed", range(4))
def test_sets_that_hang_together_are_routed_like_all_at_once(seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(12)]
    supply = {tuple(sorted(rng.sample(names, rng.choice([1, 1, 2])))): rng.randrange(0, 50) for _ in range(14)}
    sizes = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            sizes[s] += n
    quota = {s: rng.randrange(0, 120) for s in sizes}
    apart = m.given(supply, quota)
    whole = {p: sum(f.values()) for p, f in m.route(supply, quota).items()}
    rounds = lambda given: sum(c * min(max(given.get(p, 0) - i * n, 0), n) for p, n in supply.items() for i, c in enumerate(m.ROUND_COSTS))
    assert sum(apart.values()) == sum(whole.values()) and rounds(apart) == rounds(whole)


def test_too_many_sets_that_hang_together(monkeypatch):
    monkeypatch.setattr(m, "MAX_OVERLAPS", 2)
    supply = {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1}
    with pytest.raises(ValueError, match="hang together"):
        m.given(supply, dict.fromkeys("abcd", 1))
