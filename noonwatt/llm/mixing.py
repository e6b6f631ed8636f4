"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. A flow
routes the words of each pattern to the quotas of its sources; repeating a pattern a second
and a third time costs more each time, so words are repeated only where a quota cannot be
met otherwise. Seeded documents then make up each pattern's flow. Only one row per pattern
and per source reaches the driver.

A pattern takes whole rounds of its documents, and of one more round the documents that come
first in a seeded order; the one that crosses the quota gives just the words still missing,
so quotas are met to the word. The order depends on the rows' contents and the seed alone.

Defined results: a null text has size 0 and is never taken from. A null source is a source of
its own, last in order; an empty set of memberships gets no words. Repeated rows are taken one
by one. An empty table gives no rows.

A source that no document shares with another needs no flow: it gives its quota, round after
round. Sets of sources that hang together are routed apart from all others. More than MAX_OVERLAPS
sets of several sources that hang together, or more than MAX_SOURCES sets in all, raise an error.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.llm.common import fresh, small_side, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Times that a document may be taken, and what a word costs in its first, second ... round.
ROUND_COSTS = (0, 1, 3)
#: Rows that reach the driver: patterns in all, and those of one flow, whose cost grows faster.
MAX_SOURCES, MAX_OVERLAPS = 1_000_000, 1_000
#: Hex digits of the seeded order that each narrowing step tells apart, and the steps.
DIGITS, STEPS = 3, 2
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], rounds: int = len(ROUND_COSTS)) -> dict[str | None, float]:
    """Words per source: by code point, null last, weights 1, 2, 3 repeating share all words;
    no target exceeds ``rounds`` times its source, and what exceeds is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    caps = {s: rounds * n for s, n in sizes.items()}
    # Capped sources are those with the least room per weight.
    rising = sorted(order, key=lambda s: caps[s] / weight[s])
    left, weights = sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    for s in rising:
        level = left / weights
        if level * weight[s] <= caps[s]:
            out |= {x: level * weight[x] for x in rising if x not in out}
            break
        out[s] = float(caps[s])
        left, weights = left - caps[s], weights - weight[s]
    return out


def route(supply: dict[tuple, int], quota: dict[str | None, int], costs: tuple[int, ...] = ROUND_COSTS) -> dict[tuple, dict]:
    """Words that each pattern gives each of its sources: the greatest flow of least cost.

    Successive cheapest paths with potentials. A pattern has one arc per round, dearer each
    time, so the rounds fill in order.
    """
    heads: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: dict[object, list[int]] = defaultdict(list)

    def arc(a: object, b: object, capacity: int, cost: int) -> int:
        for tail, head, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[tail].append(len(heads))
            heads.append(head), room.append(c), price.append(p)
        return len(heads) - 2

    lanes = {}
    for p, words in supply.items():
        for cost in costs:
            arc("from", ("pattern", p), words, cost)
        for s in p:
            lanes[p, s] = arc(("pattern", p), ("source", s), len(costs) * words, 0)
    for s, words in quota.items():
        arc(("source", s), "to", words, 0)
    potential: dict[object, int] = defaultdict(int)
    while True:
        far, via, heap, tie = {"from": 0}, {}, [(0, 0, "from")], 0
        while heap:
            d, _, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            for e in out[v]:
                if room[e] and (x := d + price[e] + potential[v] - potential[heads[e]]) < far.get(heads[e], x + 1):
                    far[heads[e]], via[heads[e]], tie = x, e, tie + 1
                    heapq.heappush(heap, (x, tie, heads[e]))
        if "to" not in far:
            break
        for v, d in far.items():
            potential[v] += d
        path, v = [], "to"
        while v != "from":
            path.append(via[v])
            v = heads[via[v] ^ 1]
        words = min(room[e] for e in path)
        for e in path:
            room[e] -= words
            room[e ^ 1] += words
    flow: dict[tuple, dict] = defaultdict(dict)
    for (p, s), e in lanes.items():
        flow[p][s] = room[e ^ 1]
    return flow


def _together(patterns: list[tuple]) -> list[list[tuple]]:
    """Patterns in groups that share no source with each other."""
    root: dict[str | None, str | None] = {}

    def top(s: str | None) -> str | None:
        root.setdefault(s, s)
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for first, *others in patterns:
        for s in (first, *others):
            root[top(s)] = top(first)
    groups = defaultdict(list)
    for p in patterns:
        groups[top(p[0])].append(p)
    return list(groups.values())


def given(supply: dict[tuple, int], quota: dict[str | None, int], costs: tuple[int, ...] = ROUND_COSTS) -> dict[tuple, int]:
    """Words that each pattern gives in all."""
    out: dict[tuple, int] = {}
    for group in _together([p for p in supply if p]):
        if len(group) == 1 and len(group[0]) == 1:
            p = group[0]
            out[p] = min(quota[p[0]], len(costs) * supply[p])
            continue
        if len(group) > MAX_OVERLAPS:
            raise ValueError(f"more than {MAX_OVERLAPS} sets of sources hang together; group the sources first")
        flow = route({p: supply[p] for p in group}, {s: quota[s] for p in group for s in p}, costs)
        out |= {p: sum(f.values()) for p, f in flow.items()}
    return out


def _boundary(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(pattern, prefix, before): where in the seeded order each pattern's last round ends.

    Each step counts words per pattern and prefix of the order key, finds the prefix in which
    the words run out, and goes on inside that one alone. A step's window holds at most
    16 ** DIGITS rows of a pattern.
    """
    found = rest.withColumns({"prefix": F.lit(""), "before": F.lit(0).cast("bigint")})
    n = rest.count()
    for step in range(1, STEPS + 1):
        inside = rows.join(small_side(found, n), "pattern").where(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy("pattern", "rest", "before", F.substring("key", 1, DIGITS * step).alias("prefix")).agg(
            F.sum("size").alias("words")
        )
        upto = F.sum("words").over(W.partitionBy("pattern").orderBy("prefix"))
        found = stored(
            sums.withColumn("upto", F.col("before") + upto)
            .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
            .select("pattern", "rest", "prefix", (F.col("upto") - F.col("words")).alias("before")),
            f"boundary{step}",
        )
    return found


def _keyed(docs: DataFrame, members: Column, text: str, doc_id: str, seed: str, names: list[str]) -> DataFrame:
    """``docs`` with its pattern, size and order key under ``names``. The key is of the row's
    contents, so it is the same in every run."""
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    key = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(f"`{doc_id}`").cast("string"), digest), 256)
    values = (F.array_distinct(F.sort_array(members)), size_of(text), F.substring(key, 1, 16))
    return docs.withColumns(dict(zip(names, values, strict=True)))


def _take(rows: DataFrame, plan: DataFrame, ends: DataFrame, names: list[str], taken: str) -> DataFrame:
    """``rows`` with the words ``taken`` of each. Only rows at a pattern's boundary meet in a
    window; all others are decided where they are."""
    pattern, size, key = names
    rounds, rest, end, before = fresh(rows, "rounds", "rest", "end", "before")
    n = plan.count()
    known = plan.join(small_side(ends.select("pattern", "prefix", "before"), n), "pattern", "left").select(
        F.col("pattern").alias(pattern), F.col("rounds").alias(rounds), F.col("rest").alias(rest),
        F.col("prefix").alias(end), F.col("before").alias(before),
    )
    placed = rows.join(small_side(known, n), pattern)
    prefix = F.substring(key, 1, STEPS * DIGITS)
    order = W.partitionBy(pattern).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    missing = F.col(rest) - F.col(before) - F.coalesce(F.sum(size).over(order), F.lit(0))
    part = F.greatest(F.least(F.col(size), missing), F.lit(0))
    whole = F.when(prefix < F.col(end), F.col(size)).otherwise(F.lit(0))
    of = lambda df, extra: df.withColumn(taken, (F.col(rounds) * F.col(size) + extra).cast("bigint"))
    at_end = of(placed.where(prefix == F.col(end)), part)
    others = of(placed.where(F.col(end).isNull() | (prefix != F.col(end))), whole)
    return others.unionByName(at_end).drop(rounds, rest, end, before)


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pattern, size, key) rows -> what each pattern gives, where its last round ends, and
    (source, source_size, target, quota)."""
    per_pattern = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(per_pattern) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sets of sources; group the sources first")
    supply = {tuple(r["pattern"]): r["words"] for r in per_pattern}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, words in supply.items():
        for s in p:
            sizes[s] += words
    goal = targets(sizes)
    quota = {s: int(t + 0.5) for s, t in goal.items()}
    words = given(supply, quota)
    shares = [(list(p), *(divmod(words.get(p, 0), w) if w else (0, 0))) for p, w in supply.items()]
    spark = rows.sparkSession
    shared = spark.createDataFrame(shares, "pattern array<string>, rounds bigint, rest bigint")
    ends = _boundary(rows, shared.where("rest > 0").select("pattern", "rest"))
    sources = [(s, sizes[s], goal[s], quota[s]) for s in goal]
    return shared, ends, spark.createDataFrame(sources, "source string, source_size bigint, target double, quota bigint")


def report(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Documents of one source each: doc_id, size, source_size, target, taken."""
    names = ["pattern", "size", "key"]
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text")
    )
    rows = stored(_keyed(narrow, F.array("source"), "text", "doc_id", seed, names).drop("text"), "sizes")
    shared, ends, sources = plan(rows)
    named = sources.withColumnRenamed("source", "named")
    taken = _take(rows, shared, ends, names, "taken")
    return taken.join(small_side(named, named.count()), F.col("source").eqNullSafe(F.col("named"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mix(docs: DataFrame, members: Column, text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``docs`` with ``size`` and ``taken``, without those that the mix takes nothing of.

    ``members``: an array of the sources that a row belongs to.
    """
    names = fresh(docs, "pattern", "words", "key")
    keyed = _keyed(docs, members, text, doc_id, seed, names)
    rows = stored(keyed.select(*[F.col(n).alias(c) for n, c in zip(names, ("pattern", "size", "key"), strict=True)]), "sizes")
    shared, ends, _ = plan(rows)
    size, taken = fresh(keyed, "size", "taken")
    out = _take(keyed, shared, ends, names, taken).where(F.col(taken) > 0)
    return out.withColumnRenamed(names[1], size).drop(names[0], names[2])
