"""License scan by a positional index of rare words.

Templates are short license sentences. A first pass counts in how many documents each of
their words occurs; a word weighs the more the fewer those are. The index posts, for every
template, its rarest positions only: just so many that an alignment without any of them
would miss the template's threshold. The second pass looks up the words of a document in that
index; each posting names a template and, from the relative position, where it would start.
There the template's other words are compared, their weights are added, and its key phrases
must stand whole. So the index loses no alignment that reaches the threshold.

A base template must match word for word (threshold 1), so all of its places are found.

Defined results: null and word-free texts have no words and no hits. A template that starts
before the text or ends after it counts the missing words as not matched. Repeated documents
are scanned one by one, overlapping hits all count, an empty table gives no rows. Extra
columns do not matter. What is sent to the tasks is bounded by the templates.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noonwatt.llm.common import small_batches, text_or_empty

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; ``bytes.lower`` touches no other letter."""
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """``words`` must match to ``threshold`` of their weight, positions ``key`` always."""

    label: str
    words: tuple[bytes, ...]
    key: tuple[int, ...]
    threshold: Fraction
    base: bool = False


def template(label: str, text: str, *phrases: str, threshold: str = "0.8") -> Template:
    """A sentence with its mandatory key phrases, each a run of its words."""
    words = words_of(text.encode())
    key = set()
    for phrase in phrases:
        part = words_of(phrase.encode())
        starts = [i for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part]
        if not part or not starts:
            raise ValueError(f"key phrase {phrase!r} is not in the template {text!r}")
        key.update(range(starts[0], starts[0] + len(part)))
    if not words:
        raise ValueError("a template needs words")
    return Template(label, tuple(words), tuple(sorted(key)), Fraction(threshold))


def base(label: str, phrase: str) -> Template:
    """A phrase all of whose places are wanted."""
    words = tuple(words_of(phrase.encode()))
    return Template(label, words, tuple(range(len(words))), Fraction(1), base=True)


# The contract's phrases, and opening sentences of public licenses.
BASE = (
    base("cc-by", "cc by"),
    base("gpl", "general public license"),
    base("reserved", "all rights reserved"),
)
SENTENCES = (
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    template("apache-2.0", "you may not use this file except in compliance with the license",
             "in compliance with the license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "source and binary forms", "are permitted"),
    template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             "gnu general public license", "3"),
    template("gpl-any", "you can redistribute it and or modify it under the terms of the gnu general public license",
             "gnu general public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"
             " is hereby granted", "with or without fee"),
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted"),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain",
             "public domain"),
)


def weight(documents: int, holding: int) -> int:
    """Thousandths of the inverse document frequency's logarithm, never zero."""
    return math.floor(1000 * math.log(2 + documents / (1 + holding)))


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> tuple[int, Counter]:
    """(documents, word -> documents that have it), over all documents.

    At most one row per word of the templates reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for value in batch.column(0):
                seen.update(vocabulary.intersection(words_of(value.as_py())))
        seen[b""] = rows  # no word is empty
        yield pa.record_batch(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    found = docs.select(text_or_empty(text).cast("binary").alias("text")).mapInArrow(count, "word binary, n bigint")
    counts = Counter({bytes(r[0]): r[1] for r in found.groupBy("word").agg(F.sum("n")).collect()})
    return counts.pop(b"", 0), counts


class Index:
    """The positional postings of the templates' rarest words."""

    def __init__(self, templates: Sequence[Template], documents: int, holding: Counter):
        self.templates = list(templates)
        self.weights = [[weight(documents, holding[w]) for w in t.words] for t in self.templates]
        self.totals = [sum(w) for w in self.weights]
        self.needed = [math.ceil(t.threshold * n) for t, n in zip(self.templates, self.totals)]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            rarest = sorted(range(len(t.words)), key=lambda q: (-self.weights[i][q], q))
            left = self.totals[i]
            for q in rarest:
                if left < self.needed[i]:  # what is not posted cannot reach the threshold
                    break
                self.postings[t.words[q]].append((i, q))
                left -= self.weights[i][q]

    def hits(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its weight), in order of template and start."""
        postings, n = self.postings, len(words)
        places = {
            (i, at - q) for at, word in enumerate(words) if word in postings for i, q in postings[word]
        }
        out = []
        for i, start in sorted(places):
            t = self.templates[i]
            met = [0 <= start + q < n and words[start + q] == w for q, w in enumerate(t.words)]
            got = sum(w for w, m in zip(self.weights[i], met) if m)
            if got >= self.needed[i] and all(met[q] for q in t.key):
                out.append((i, start, got / self.totals[i]))
        return out


_HIT = pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + SENTENCES, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, hits (label, start word from 0, score, base)."""
    small_batches(docs.sparkSession)
    vocabulary = frozenset(w for t in templates for w in t.words)
    index = Index(templates, *document_frequency(docs, vocabulary, text))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits = [], []
            for value in batch.column(1):
                words = words_of(value.as_py())
                n_words.append(len(words))
                hits.append([
                    {"label": (t := index.templates[i]).label, "start": start, "score": score, "base": t.base}
                    for i, start, score in index.hits(words)
                ])
            yield pa.record_batch(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(_HIT))],
                names=["doc_id", "n_words", "hits"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    more = StructType.fromDDL(
        "n_words bigint, hits array<struct<label: string, start: bigint, score: double, base: boolean>>"
    )
    return rows.mapInArrow(find, StructType([rows.schema["doc_id"], *more]))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    of_base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(of_base, lambda h: h["start"])

    def names(hits: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    return scan(docs, **options).select(
        "doc_id",
        "n_words",
        F.size(of_base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(of_base).alias("base_labels"),
        names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
