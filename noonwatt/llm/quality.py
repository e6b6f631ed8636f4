"""A quality classifier by compression.

Two zstandard dictionaries are built from labelled texts, one of good and one of bad ones. A
text that the bad dictionary compresses further than the good one looks bad: the difference of
the two compressed sizes, divided by their sum, is measured over the whole text and over its
worst block of BLOCK bytes, and a logistic calibration turns the two numbers into a score.

Fitting reads a bounded sample of labelled rows: for the dictionaries a piece of PIECE
characters, from anywhere in the text, of the first DICTIONARY_TEXTS of each label in a seeded
order; for the calibration the whole texts of the first CALIBRATION_TEXTS others. Scoring reads
every text whole. Labels, languages, sources and ids are no input of a score.

Defined results: a null text is scored like an empty one, which says nothing: it gets the share
of good among the calibration texts. Where the dictionaries' labels lack one of the two, every score is the mean of
the labels, or 0.5 without any. Labels other than 0 and 1, and
labels of unknown documents, are not used; a document with two labels counts as both. Of
documents that share an id one piece and one point are learnt from, the least; so what reaches
the driver is bounded. Repeated documents get the same score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt.llm.common import small_batches

LEVEL = 6
DICTIONARY_BYTES = 1 << 20
BLOCK = 500
PIECE = 512
#: The bounded sample that is fitted. DICTIONARY_TEXTS pieces fill DICTIONARY_BYTES.
DICTIONARY_TEXTS, CALIBRATION_TEXTS = 4_000, 8_000


@dataclass(frozen=True)
class Dictionaries:
    """Raw content that texts are compressed against."""

    good: bytes
    bad: bytes

    def __reduce__(self):  # compressors stay where they were made
        return Dictionaries, (self.good, self.bad)

    @cached_property
    def _sizes(self) -> list[Callable[[bytes], bytes]]:
        out = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False).compress)
        return out

    def difference(self, part: bytes) -> float:
        """From -1 to 1: above 0 if the good dictionary fits better."""
        good, bad = (len(compress(part)) for compress in self._sizes)
        return (bad - good) / (bad + good)

    def features(self, text: str | None) -> tuple[float, float]:
        """The difference of the whole text, and the least one of a block. A last block of
        under half the length counts with the one before it."""
        data = (text or "").encode()
        if len(data) < 1.5 * BLOCK:
            d = self.difference(data)
            return d, d
        ends = [*range(BLOCK, len(data) - BLOCK // 2, BLOCK), len(data)]
        blocks = (data[a:b] for a, b in zip([0, *ends], ends, strict=False))
        return self.difference(data), min(map(self.difference, blocks))


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries | None
    #: Of 1, the whole text's and the worst block's difference.
    weights: tuple[float, float, float]
    #: The score of a text that says nothing.
    share: float

    def score(self, text: str | None) -> float:
        if not text or self.dictionaries is None:
            return self.share
        x = float(np.dot(self.weights, (1.0, *self.dictionaries.features(text))))
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the bias first, by Newton steps. The ridge acts on
    standardised columns, so few and separable points give no extreme scores."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.c_[np.ones(len(x)), x / scale]
    w, shrink = np.zeros(z.shape[1]), ridge * np.diag([0.0, *[1.0] * len(scale)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + shrink, z.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w / np.r_[1.0, scale]


def _pool(labels: DataFrame, doc_id: str, label: str, learn_from: Column) -> DataFrame:
    """(id, label, order): labelled ids that may be learnt from, in a seeded order."""
    rows = labels.where(learn_from & F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull())
    return rows.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"),
        F.xxhash64(F.lit("quality"), F.col(f"`{doc_id}`")).alias("order"),
    )


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Dictionaries from one half of the labelled ids, the calibration from the other.

    ``learn_from``: which rows of ``labels`` may be used.
    """
    small_batches(docs.sparkSession)
    pool = _pool(labels, doc_id, label, learn_from)
    half = F.pmod("order", F.lit(2)) == 0
    order = ("order", "id", "label")
    firsts = [pool.where(half & (F.col("label") == q)).orderBy(*order).limit(DICTIONARY_TEXTS) for q in (0, 1)]
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    offset = F.pmod(F.shiftright("order", 8), F.greatest(F.char_length("text") - PIECE, F.lit(0)) + 1)
    pieces = (
        rows.join(F.broadcast(firsts[0].unionByName(firsts[1])), "id")
        .groupBy("label", "order")
        .agg(F.min(F.substr("text", (offset + 1).cast("int"), F.lit(PIECE))).alias("piece"))
        .collect()  # at most 2 * DICTIONARY_TEXTS pieces
    )
    content = {0: b"", 1: b""}
    for r in sorted(pieces):
        if len(content[r["label"]]) < DICTIONARY_BYTES:
            content[r["label"]] += r["piece"].encode()
    chosen = pool.where(~half).orderBy(*order).limit(CALIBRATION_TEXTS)
    if not (content[0] and content[1]):
        mean = pool.agg(F.avg("label")).first()[0]
        return Model(None, (0.0, 0.0, 0.0), 0.5 if mean is None else float(mean))
    made = Dictionaries(content[1][:DICTIONARY_BYTES], content[0][:DICTIONARY_BYTES])
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(t.as_py()) for t in batch.column(2)]
            whole, block = (pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))
            yield pa.record_batch([*batch.columns[:2], whole, block], names=["id", "label", "whole", "block"])

    measured = rows.where("text != ''").join(F.broadcast(chosen.distinct()), "id").select("id", "label", "text")
    points = (
        measured.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, label int, whole double, block double")
        .groupBy("id", "label")
        .agg(F.min(F.struct("whole", "block")).alias("x"))
        .select("label", "x.*")
        .collect()  # at most CALIBRATION_TEXTS
    )
    x, y = np.array([r[1:] for r in points]).reshape(-1, 2), np.array([r[0] for r in points], float)
    if len(set(y)) < 2:  # nothing to calibrate on: the plain sign decides
        return Model(made, (0.0, 0.0, 50.0), 0.5)
    order_free = np.lexsort((y, x[:, 1], x[:, 0]))  # sums must not depend on the order of tasks
    return Model(made, tuple(logistic(x[order_free], y[order_free])), float(y.mean()))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, score (chance of label 1), predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.record_batch([batch.column(0), scores], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(judge, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are never learnt from: CRC-32 of the id as text leaves 1 of 3."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
