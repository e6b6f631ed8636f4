"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models are counted over all URLs that the rules decide,
one over the allowed and one over the blocked. Every gram that occurs LEAST times is kept, so
frequent beginnings get long contexts and rare ones short ones, and the tables grow with the
input. The score of a URL is the difference of the two log-likelihoods per character; the
cut-off is calibrated on decided URLs that were held out of the counts.

All steps are joins and aggregations of columns. What a character scores depends on no more than
the ORDER characters that end with it, so each distinct window of them is scored once. Grams of
all lengths are looked up in one join: those of the lengths that together have up to MODEL_ROWS
are broadcast, the longer ones joined by shuffle. Of more windows than that the most frequent
are broadcast and the others, none of which is hot, joined by shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no
rule. If the rules leave one of the two classes empty there is nothing to compare with, and
every undecided URL is allowed. Repeated rows are judged one by one; empty tables give no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noonwatt.llm.common import stored, text_or_empty

#: Longest gram: the character and up to ORDER - 1 before it.
ORDER = 6
#: Occurrences from which the filter keeps a gram.
LEAST = 2
#: Rows that are broadcast. A model may be bounded to as many grams of each length.
MODEL_ROWS = 32_768
#: Characters of a URL that are looked at together, ORDER at least.
PIECE = 256
#: Characters that the shorter context contributes, as if seen.
PRIOR = 4.0
#: Nominal alphabet of the empty context.
ALPHABET = 256
#: Decided URLs whose MD5 begins with a hex digit below this are held out of the counts and
#: calibrate the cut-off: 3 of 16.
HELD_BELOW = "3"
#: Steps per nat in which the calibration counts scores, and the largest score it tells apart.
STEPS, RANGE = 256, 8


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, name: str) -> Rule:
    host, slash, path = name.partition("/")
    return Rule(host, slash + path, verdict)


def host_of(url: str = "url") -> Column:
    found = F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(r: Rule) -> Column:
    host = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
    return host & F.col("path").startswith(r.path)


def decided(pages: DataFrame, rules: list[Rule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """row, page_id, url, host, path, rule, by_rule. The longest fitting rule wins."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    pick = lambda value: F.coalesce(F.lit(None).cast("string"), *[F.when(_fits(r), F.lit(value(r))) for r in ranked])
    return (
        pages.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{page_id}`").alias("page_id"),
            text_or_empty(url).alias("url"),
        )
        .withColumns({"host": host_of("url"), "path": path_of("url")})
        .withColumns({"rule": pick(lambda r: r.name), "by_rule": pick(lambda r: r.verdict)})
    )


def _positions(urls: DataFrame, *others: str) -> DataFrame:
    """``others`` and a row per character of the URL: ``text`` with the character at ``at``, whether
    it is the ``last`` one, and ``gram1`` to ``gramN`` that end at it, null where the URL has
    not begun yet.

    A URL is cut into pieces first, each with the characters before it that grams reach into. So a
    character costs the same in a long URL as in a short one.
    """
    pieces = F.regexp_extract_all("url", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    before = F.concat(F.array(F.lit("")), F.slice("pieces", 1, F.greatest(F.size("pieces") - 1, F.lit(0))))
    cut = (
        urls.where(F.length("url") > 0)
        .select(*others, pieces.alias("pieces"))
        .withColumns({"n_pieces": F.size("pieces"), "before": before})
        .select(*others, "n_pieces", F.posexplode(F.arrays_zip("before", "pieces")).alias("number", "piece"))
        .select(
            *others,
            (F.col("number") == F.col("n_pieces") - 1).alias("ends"),
            F.length(F.right("piece.before", F.lit(ORDER))).alias("skip"),
            F.concat(F.right("piece.before", F.lit(ORDER)), "piece.pieces").alias("text"),
        )
    )
    at = cut.withColumn("at", F.explode(F.sequence(F.col("skip") + 1, F.length("text"))))
    grams = {
        f"gram{n}": F.when(F.col("at") >= n, F.substring("text", F.col("at") - F.lit(n - 1), F.lit(n)))
        for n in range(1, ORDER + 1)
    }
    return at.withColumns({"last": F.col("ends") & (F.col("at") == F.length("text")), **grams}).drop("ends", "skip")


def counts(urls: DataFrame) -> DataFrame:
    """(len, gram, accepted, rejected, accepted_before, rejected_before): occurrences of each gram, and how
    often it has a character after it."""
    each = _positions(urls, "accepted").select(
        "accepted", "last", F.posexplode(F.array(*[F.col(f"gram{n}") for n in range(1, ORDER + 1)])).alias("n", "gram")
    ).where(F.col("gram").isNotNull())
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return each.groupBy((F.col("n") + 1).alias("len"), "gram").agg(
        one(F.col("accepted")).alias("accepted"),
        one(~F.col("accepted")).alias("rejected"),
        one(F.col("accepted") & ~F.col("last")).alias("accepted_before"),
        one(~F.col("accepted") & ~F.col("last")).alias("rejected_before"),
    )


def _short(lengths: Column, table: DataFrame) -> int:
    """Up to which length the grams of ``table`` are within MODEL_ROWS, all together."""
    rows = {r["len"]: r["count"] for r in table.groupBy(lengths.alias("len")).count().collect()}
    return max(n for n in range(ORDER + 1) if sum(v for k, v in rows.items() if k <= n) <= MODEL_ROWS)


def _ends(of: DataFrame, whole: str) -> DataFrame:
    """``of`` with each ``gram`` that its ``whole`` ends with, where ``own``, and that it ends with before its last
    character, where not."""
    size, n = F.length(whole), F.col("n")
    before = F.when(n < size, F.substring(whole, size - n, n))
    return (
        of.withColumn("n", F.explode(F.sequence(F.lit(1), size)))
        .select(*of.columns, F.posexplode(F.array(F.right(F.col(whole), n), before)).alias("place", "gram"))
        .where(F.col("gram").isNotNull())
        .select(*of.columns, (F.col("place") == 0).alias("own"), "gram")
    )


def _meet(asked: DataFrame, table: DataFrame, short: int) -> DataFrame:
    """``asked`` with what ``table`` has of its ``gram``, else null. Grams of up to ``short`` characters are broadcast;
    the longer ones, each of which fewer ask for, are shuffled."""
    if short == ORDER:
        return asked.join(F.broadcast(table), "gram", "left")
    brief = F.length("gram") <= short
    few = asked.where(brief).join(F.broadcast(table.where(brief)), "gram", "left")
    return few.unionByName(asked.where(~brief).join(table.where(~brief).hint("merge"), "gram", "left"))


def grams(urls: DataFrame, least: int | None = None) -> DataFrame:
    """(gram, ratio, escape).

    Grams that occur ``least`` times are kept; without it, those that make up 1 / MODEL_ROWS of
    all grams of their length.

    ``ratio``: the log of the probability ratio of the gram's last character after the
    others, less the escapes of that context and its ends. ``escape``: the summed log ratio
    of what the two models leave to shorter contexts, over the gram as a context and all its
    ends. A character scores the ratio of the longest kept gram that ends at it, plus the
    escape of the longest kept context before it.

    Each gram looks up its ends, so all lengths take the same few joins: plans, and what the
    driver holds of them, do not grow with ORDER.
    """
    counted = stored(counts(urls), "counts")
    total = counted.where("len = 1").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    # One least count for all lengths: what begins or ends a kept gram is then kept too.
    least = max(LEAST, -(-(total["a"] + total["r"]) // MODEL_ROWS)) if least is None else least
    kept = counted.where(F.col("accepted") + F.col("rejected") >= least)
    short = _short(F.col("len"), kept)
    begun = kept.select("gram", F.col("accepted_before").alias("ca"), F.col("rejected_before").alias("cr"))
    head = F.left(F.col("gram"), F.length("gram") - 1)
    heads = kept.select(F.col("gram").alias("whole"), "len", "accepted", "rejected", head.alias("gram"))
    events = _meet(heads, begun, short).select(
        F.col("whole").alias("gram"),
        F.struct(
            "len",
            "accepted",
            "rejected",
            F.coalesce("ca", F.lit(total["a"])).alias("ca"),  # the empty context is before every character
            F.coalesce("cr", F.lit(total["r"])).alias("cr"),
        ).alias("event"),
    )
    ends = _ends(kept.select(F.col("gram").alias("whole")), "whole").where("own").drop("own")
    chain = _meet(ends, events, short).groupBy("whole").agg(F.sort_array(F.collect_list("event")).alias("chain"))
    after = lambda n, c: lambda p, x: (x[n] + PRIOR * p) / (x[c] + PRIOR)
    accepted, rejected = after("accepted", "ca"), after("rejected", "cr")
    shorter, last = F.slice("chain", F.lit(1), F.size("chain") - 1), F.element_at("chain", -1)
    chances = stored(
        chain.select(
            F.col("whole").alias("gram"),
            last.alias("last"),
            F.aggregate(shorter, F.lit(1 / ALPHABET), accepted).alias("qa"),
            F.aggregate(shorter, F.lit(1 / ALPHABET), rejected).alias("qr"),
        )
        .withColumns({"pa": accepted(F.col("qa"), F.col("last")), "pr": rejected(F.col("qr"), F.col("last"))})
        .drop("last"),
        "chances",
    )
    left = chances.where(F.length("gram") > 1).groupBy(head.alias("gram")).agg(
        *[F.greatest(1 - F.sum(c), F.lit(1e-6)).alias(c) for c in ("pa", "pr", "qa", "qr")]
    )
    leaves = left.select("gram", (F.log("pa") - F.log("qa") - F.log("pr") + F.log("qr")).alias("leaves"))
    asked = _ends(chances.select(F.col("gram").alias("whole"), (F.log("pa") - F.log("pr")).alias("ratio")), "whole")
    summed = lambda c: F.sum(F.when(c, F.coalesce("leaves", F.lit(0.0))).otherwise(0.0))
    found = (
        _meet(asked, leaves, short)
        .groupBy("whole", "ratio")
        .agg(summed(F.col("own")).alias("escape"), summed(~F.col("own")).alias("above"))
    )
    ratio = (F.col("ratio") - F.col("above")).alias("ratio")
    return stored(found.select(F.col("whole").alias("gram"), ratio, "escape"), "grams")


def model(urls: DataFrame, least: int | None = None) -> list[DataFrame]:
    """The ``grams`` of each length, from 1 to ORDER."""
    kept = grams(urls, least)
    return [kept.where(F.length("gram") == n) for n in range(1, ORDER + 1)]


def _values(windows: DataFrame, kept: DataFrame) -> DataFrame:
    """``windows`` with ``value``, what the last character of each scores, in millionths: whole
    numbers add up to the same sum in any order."""
    found = _meet(_ends(windows, "window"), kept, _short(F.length("gram"), kept))
    longest = lambda c, own: F.coalesce(F.max_by(c, F.when(own & F.col(c).isNotNull(), F.length("gram"))), F.lit(0.0))
    value = longest("ratio", F.col("own")) + longest("escape", ~F.col("own"))
    return found.groupBy("window", "times").agg(F.round(value * 1_000_000).cast("bigint").alias("value"))


def _windows(urls: DataFrame) -> DataFrame:
    """(row, window): the characters that each one's score depends on."""
    window = F.coalesce(*[F.col(f"gram{n}") for n in range(ORDER, 0, -1)])
    return _positions(urls, "row").select("row", window.alias("window"))


def valued(urls: DataFrame, kept: DataFrame) -> DataFrame:
    """(window, times, value) of the distinct windows of ``urls``."""
    windows = stored(_windows(urls).groupBy("window").agg(F.count(F.lit(1)).alias("times")), "windows")
    return stored(_values(windows, kept), "values")


def summed(urls: DataFrame, values: DataFrame) -> DataFrame:
    """``urls`` with ``score``; ``values`` has all their windows."""
    at = _windows(urls)
    size = values.agg(F.count(F.lit(1)).alias("rows"), F.sum("times").alias("times")).first()
    if size["rows"] <= MODEL_ROWS:
        each = at.join(F.broadcast(values), "window")
    else:
        hot = F.col("times") >= -(-size["times"] // MODEL_ROWS)  # at most MODEL_ROWS of them
        often = F.broadcast(values.where(hot))
        seldom = at.join(often, "window", "left_anti").join(values.where(~hot).hint("merge"), "window")
        each = at.join(often, "window").unionByName(seldom)
    per_url = each.groupBy("row").agg(F.sum("value").alias("sum"))
    total = F.coalesce("sum", F.lit(0).cast("bigint"))
    return (
        urls.join(per_url, "row", "left")
        .withColumn("score", total / F.greatest(F.length("url"), F.lit(1)) / 1_000_000)
        .drop("sum")
    )


def scored(urls: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``urls`` with ``score``: the log-likelihood difference per character, 0 if empty. Their
    numbers ``row`` are unique."""
    return summed(urls, valued(urls, reduce(DataFrame.unionByName, tables)))


def cutoff(held: DataFrame) -> float:
    """The score that best tells held-out accepted URLs from rejected ones: the least sum
    of the two error rates. Between two scores that occur every cut-off does the same; of all
    that are equally good the one nearest to 0 is taken, where both models fit alike."""
    step = F.round(F.greatest(F.least("score", F.lit(float(RANGE))), F.lit(float(-RANGE))) * STEPS).cast("int")
    bins = held.groupBy(step.alias("bin")).agg(  # at most 2 * RANGE * STEPS + 1 rows
        F.sum(F.col("accepted").cast("int")).alias("a"), F.sum((~F.col("accepted")).cast("int")).alias("r")
    )
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rate = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(every))
    top = F.col("bin") - 0.5
    bottom = F.coalesce(F.lag("bin").over(W.orderBy("bin")), F.lit(-RANGE * STEPS - 1)) + 0.5
    errors = bins.select(
        F.round(F.coalesce(rate("a"), F.lit(0.0)) + 1 - F.coalesce(rate("r"), F.lit(0.0)), 9).alias("error"),
        F.least(top, F.greatest(bottom, F.lit(0.0))).alias("at"),
    )
    best = errors.orderBy("error", F.abs("at"), "at").select("at").first()
    return 0.0 if best is None else best[0] / STEPS


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Every URL: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    found = stored(decided(pages, rules, url, page_id), "decided")  # row numbers must not change
    undecided, held_out = F.col("by_rule").isNull(), F.substring(F.md5("url"), 1, 1) < HELD_BELOW
    known = found.where(~undecided).select("row", "url", (F.col("by_rule") == "allow").alias("accepted"), held_out.alias("held"))
    classes = {r["accepted"] for r in known.where(~F.col("held") & (F.length("url") > 0)).select("accepted").distinct().collect()}
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    by_rule = found.where(~undecided).withColumns(
        {"verdict": F.col("by_rule"), "score": F.lit(None).cast("double")}
    )
    rest = found.where(undecided).select("row", "page_id", "url", "host", "path", "rule")
    if len(classes) < 2:
        judged = rest.withColumns({"score": F.lit(0.0), "verdict": F.lit("allow")})
    else:
        held = known.where("held").select("row", "url", "accepted")
        values = valued(found.where(undecided | held_out), grams(known.where(~F.col("held")), LEAST))
        least = cutoff(summed(held, values))
        judged = summed(rest, values).withColumn("score", F.col("score") - F.lit(least)).withColumn(
            "verdict", F.when(F.col("score") >= 0, "allow").otherwise("block")
        )
    return reduce(DataFrame.unionByName, [by_rule.select(columns), judged.select(columns)])
