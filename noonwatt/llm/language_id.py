"""Language identification by Bayesian evidence fusion.

For each row the log-likelihoods of its text under character-trigram models, the declared
language and a prior of its host are added up. The models are counted over all rows that
declare a language. The host priors are hierarchically smoothed: counts per host lean on the
counts of its address suffix, and those on the counts of all rows; one grouped aggregation
gives all of them.

A row is rejected when its text has no letters, when no language reaches MIN_POSTERIOR, or when
"none of these" explains text and declaration better than every language: trigrams that are all
equally likely, as in random letters, encoded data or scripts that no row declares. Such rows
do not vote for their host. ``posterior`` is that among the languages.

Defined results: a null or blank text has no letters. A null declaration
says nothing; a null host or suffix is a host or suffix like any other. Every declared
language is one, however few rows declare it; more than MAX_LANGUAGES of them raise an error.
Where no row declares a language there is nothing to compare with: ``language`` is null and
only texts without letters are rejected. Of equal scores the first language by name wins.
Repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt.llm.common import fresh, small_batches, small_side, stored

#: Trigrams of bytes are hashed to 2 ** BITS counters.
BITS = 15
#: Languages whose models every task holds, 128 KB each.
MAX_LANGUAGES = 256
#: Trigrams whose scores are added up at once.
CHUNK = 1 << 14
#: Neighbouring trigrams overlap: so many count as one independent observation.
EVIDENCE = 4
#: Chance that a declared language is the true one.
DECLARED = 0.9
#: Rows that the level above contributes to a host or suffix, as if counted.
PRIOR = 20.0
MIN_POSTERIOR = 0.5
#: Chance that a text is in none of the languages.
NONE_OF_THESE = 0.01

#: Letters and bytes of other characters stay, A-Z as a-z; all else is a space.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of a text with a letter in the middle."""
    b = _LETTERS[np.frombuffer(b" " + (text or "").encode() + b" ", np.uint8)].astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - BITS))[b[1:-1] != 32]


def languages(docs: DataFrame, declared: str) -> list[str]:
    named = docs.select(F.col(f"`{declared}`").alias("lang")).dropna().distinct()
    names = sorted(r["lang"] for r in named.limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} declared languages")
    return names


def text_model(docs: DataFrame, names: list[str], text: str, declared: str) -> np.ndarray:
    """log P(trigram | language), one row per trigram and a column per language, over all
    rows that declare one of ``names``."""
    size = 1 << BITS
    index = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), size), np.int64)
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[index[lang]] += np.bincount(trigrams(t.as_py()), minlength=size)
        lang, gram = np.nonzero(seen)
        yield pa.record_batch([lang.astype(np.int32), gram.astype(np.int32), seen[lang, gram]], names=["lang", "gram", "n"])

    rows = docs.select(F.col(f"`{declared}`").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    summed = (
        rows.where(F.col("lang").isin(names))
        .mapInArrow(count, "lang int, gram int, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most 2 ** BITS rows per language
    )
    counts = np.full((size, len(names)), 0.5)
    counts[summed["gram"].to_numpy(), summed["lang"].to_numpy()] += summed["n"].to_numpy()
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _evidence(docs: DataFrame, names: list[str], model: np.ndarray):
    """A column function (text, declared) -> (letters, scores): the log-likelihood of text
    and declaration under each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    index = {name: i for i, name in enumerate(names)}
    other = np.log((1 - DECLARED) / max(1, len(names) - 1))

    @F.pandas_udf("letters bigint, scores array<double>")
    def evidence(text: pd.Series, declared: pd.Series) -> pd.DataFrame:
        letters, scores = [], []
        for t, lang in zip(text, declared, strict=True):
            grams = trigrams(t)
            score = np.zeros(len(names))
            for start in range(0, len(grams), CHUNK):
                score += shared.value[grams[start : start + CHUNK]].sum(axis=0, dtype=np.float64)
            score /= EVIDENCE
            if lang in index:
                told = np.full(len(names), other)
                told[index[lang]] = np.log(DECLARED)
                score = score + told
            letters.append(len(grams))
            scores.append(score)
        return pd.DataFrame({"letters": letters, "scores": scores})

    return evidence


def foreign(letters: Column, scores: Column, declared: Column, n: int) -> Column:
    """Whether "none of these" scores above all ``n`` languages. Hosts have no say: a language
    that is rare at its host is still a language."""
    told = F.when(declared.isNull(), 0.0).otherwise(float(np.log((1 - DECLARED) / max(1, n - 1))))
    uniform = letters * float(-BITS * np.log(2) / EVIDENCE)
    return F.array_max(scores) < uniform + told + float(np.log(NONE_OF_THESE))


def host_priors(votes: DataFrame, names: list[str]) -> DataFrame:
    """(suffix, host, prior): log P(language | host) from one vote per row."""
    counted = votes.groupBy("suffix", "host").agg(
        *[F.sum(F.when(F.col("vote") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(names))]
    )
    hosts = stored(counted, "hosts")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(len(names))])
    total = hosts.agg(*[F.sum(f"n{i}") for i in range(len(names))]).first()
    all_rows = sum(n or 0 for n in total)
    root = [((n or 0) + 1) / (all_rows + len(names)) for n in total]
    add = lambda stem: sum((F.col(f"{stem}{i}") for i in range(1, len(names))), F.col(f"{stem}0"))
    by_suffix = [(F.col(f"s{i}") + PRIOR * root[i]) / (add("s") + PRIOR) for i in range(len(names))]
    suffixes = suffixes.select(F.col("suffix").alias("above"), *[p.alias(f"p{i}") for i, p in enumerate(by_suffix)])
    own = [F.log((F.col(f"n{i}") + PRIOR * F.col(f"p{i}")) / (add("n") + PRIOR)) for i in range(len(names))]
    # All hosts of documents have one suffix: the few suffixes go to the hosts.
    suffixes = stored(suffixes, "suffixes")
    near = small_side(suffixes, suffixes.count())
    return hosts.join(near, F.col("suffix").eqNullSafe(F.col("above"))).select("suffix", "host", F.array(*own).alias("prior"))


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
             suffix: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what was found about each row, under the helper names that are returned:
    language, posterior, letters, rejected.
    """
    stems = ("letters", "scores", "language", "posterior", "rejected", "suffix", "host", "prior")
    col = dict(zip(stems, fresh(docs, *stems), strict=True))
    names = languages(docs, declared)
    small_batches(docs.sparkSession)
    if not names:
        found = docs.withColumns({
            col["letters"]: F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[a-zA-Z\x{80}-\x{10FFFF}]")), F.lit(0)).cast("bigint"),
            col["language"]: F.lit(None).cast("string"),
            col["posterior"]: F.lit(None).cast("double"),
        })
        return found.withColumn(col["rejected"], F.col(col["letters"]) == 0), col
    evidence = _evidence(docs, names, text_model(docs, names, text, declared))
    found = evidence(F.col(f"`{text}`").cast("string"), F.col(f"`{declared}`"))
    place = (suffix if suffix is not None else F.lit("")).alias("suffix"), F.col(f"`{host}`").alias("host")
    best = F.array_position(F.col("found.scores"), F.array_max("found.scores")) - 1
    votes = docs.select(*place, F.col(f"`{declared}`").alias("declared"), found.alias("found")).where("found.letters > 0")
    votes = votes.where(~foreign(F.col("found.letters"), F.col("found.scores"), F.col("declared"), len(names)))
    votes = votes.select("suffix", "host", best.alias("vote"))
    priors = stored(host_priors(votes, names), "priors")
    known = small_side(priors.select(*[F.col(c).alias(col[c]) for c in ("suffix", "host", "prior")]), priors.count())
    (whole,) = fresh(docs, "found")
    judged = docs.withColumn(whole, found).join(
        known, F.col(col["host"]).eqNullSafe(F.col(f"`{host}`")) & F.col(col["suffix"]).eqNullSafe(place[0]), "left"
    )
    # A host none of whose rows has letters has no votes.
    prior = F.coalesce(col["prior"], F.array(*[F.lit(0.0)] * len(names)))
    top = F.array_max(col["scores"])
    out = (
        judged.withColumn(col["scores"], F.zip_with(F.col(whole)["scores"], prior, lambda a, b: a + b))
        .withColumn(col["letters"], F.col(whole)["letters"])
        .withColumn(col["posterior"], 1 / F.aggregate(
            col["scores"], F.lit(0.0), lambda total, s: total + F.exp(s - top)))
        .withColumn(col["language"], F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(col["scores"], top) - 1).cast("int")))
        .withColumn(col["rejected"], (F.col(col["letters"]) == 0) | (F.col(col["posterior"]) < MIN_POSTERIOR)
                    | foreign(F.col(whole)["letters"], F.col(whole)["scores"], F.col(f"`{declared}`"), len(names)))
        .drop(whole, col["scores"], col["suffix"], col["host"], col["prior"])
    )
    return out, col


def report(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, language, posterior, letters, rejected."""
    found, col = identify(docs, **options)
    return found.select(
        F.col(f"`{doc_id}`").alias(doc_id), *[F.col(col[c]).alias(c) for c in ("language", "posterior", "letters", "rejected")]
    )


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows that are not rejected, with their own columns."""
    found, col = identify(docs, **options)
    return found.where(~F.col(col["rejected"])).select(*[F.col(f"`{c}`") for c in docs.columns])
