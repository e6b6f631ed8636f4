"""Token counts of a unigram tokenizer by dynamic programming over a shared trie.

A text is cut into pre-tokens at white space. The distinct pre-tokens of a batch form a trie.
The best segmentation of a prefix under the unigram model depends on that prefix alone, so
its forward score and token count are worked out once per trie node, however many pre-tokens
and documents share the node; a pre-token's count is what its terminal node stores. Nothing is
shuffled: each task builds the trie of what it reads.

The vocabulary is a file of a public tokenizer, given by path and read on the driver; it is
never trained here. Its pieces are ranked by merge order, and the unigram log-probability of
the piece of rank r is taken by Zipf's law, -log(r + RANK_SHIFT) up to a constant. A character
that no piece covers is spelled in bytes, one token each.

Defined results: a null, empty or blank text has no pre-tokens and 0 tokens. Of segmentations
with equal score the one with fewer tokens counts. Pre-tokens of any length are segmented
whole. Repeated documents are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonwatt.llm.common import small_batches

#: What a sentence piece begins a word with.
SPACE = "▁"
RANK_SHIFT = 10.0
#: Counts of pre-tokens a task keeps between batches. Beyond, it forgets them and goes on:
#: results are the same, only worked out again.
KEPT = 200_000


@dataclass(frozen=True)
class Unigram:
    """Log-probabilities of pieces, the longest piece, and the score of one spelled byte."""

    scores: dict[str, float]
    longest: int
    byte: float

    @staticmethod
    def of(pieces: Iterable[str]) -> Unigram:
        """From pieces in order of rank."""
        scores = {p: -math.log(i + RANK_SHIFT) for i, p in enumerate(pieces)}
        worst = -math.log(len(scores) + RANK_SHIFT)
        return Unigram(scores, max(map(len, scores), default=1), 2 * worst)

    @staticmethod
    def load(path: str) -> Unigram:
        """The ordinary pieces of a sentencepiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids.sort(key=lambda i: (-model.get_score(i), i))
        return Unigram.of(model.id_to_piece(i) for i in ids)


def pre_tokens(text: str | None) -> list[bytes]:
    """Runs of other characters than [\\x20\\x09-\\x0D], in UTF-8."""
    return (text or "").encode().split()


def terminal_counts(words: Iterable[bytes], model: Unigram) -> dict[bytes, int]:
    """Tokens of each distinct pre-token.

    The trie is walked depth first, which visits the pre-tokens in sorted order: the stack
    holds the forward states of the nodes from the root to the current one, and a pre-token
    goes on from the last node that it shares with the one before.
    """
    scores, longest, byte = model.scores, model.longest, model.byte
    out: dict[bytes, int] = {}
    path = SPACE
    # Of each node on the path: best score, and tokens used for it.
    best: list[float] = [0.0]
    tokens: list[int] = [0]

    def step(i: int) -> None:
        """Push the node of path[:i]."""
        n = len(path[i - 1].encode())
        top, used = best[i - 1] + n * byte, tokens[i - 1] + n
        for j in range(max(0, i - longest), i):
            s = scores.get(path[j:i])
            if s is not None:
                s += best[j]
                if s > top or s == top and tokens[j] + 1 < used:
                    top, used = s, tokens[j] + 1
        best.append(top)
        tokens.append(used)

    step(1)
    for raw in sorted(words):
        word = SPACE + raw.decode()
        shared = 1
        for a, b in zip(word[1:], path[1:], strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        path = word
        for i in range(shared + 1, len(word) + 1):
            step(i)
        out[raw] = tokens[-1]
    return out


def count_tokens(docs: DataFrame, model: Unigram, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words (pre-tokens), n_tokens."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch):
                split = [pre_tokens(t.as_py()) for t in part.column(1)]
                new = {w for words in split for w in words}.difference(known)
                if len(known) + len(new) > KEPT:
                    new = {w for words in split for w in words}
                    known = {}
                known.update(terminal_counts(new, shared.value))
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(words) for words in split], pa.int64()),
                        pa.array([sum(map(known.__getitem__, words)) for words in split], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few texts are split into words at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
