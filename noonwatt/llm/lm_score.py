"""Language-model scoring by cross-entropy difference.

Two word-bigram models share one vocabulary, one set of bigrams and one smoothing: the target
model is counted over the target documents, the background model over all documents. Each
word's loss under either model is taken, and a document's score is the mean of the
differences: below 0, its text is more like the target than like the rest.

The vocabulary is every word that occurs twice, and the model keeps every bigram that occurs
twice, so both grow with the input. All other words are one unknown word; other bigrams fall
back to single words.

Texts are read once and cut into blocks: documents as lists of word numbers that only hold in
their block, written. Target ids meet the blocks' ids, not the texts. A block passes each of its
distinct words on once, with counts; a shard of words adds them up and answers every block with
ids and totals. Then each distinct bigram goes to its shard and back in the same way. An answer
follows the order of what was asked, so it carries counts alone. No task holds a model, and no
word or bigram is hot: a block names it once.

Defined results: words are runs of characters other than white space, with A-Z lower-cased;
words of more than LONGEST bytes are unknown. A null, empty or blank text has no words, null
losses and score 0. Without any target document the target model is uniform. An id that is
null is no target; a target id that repeats counts once; repeated documents count as often as
they occur. The sizes of blocks and shards change no result. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt.llm.common import small_batches, small_side, stored
from noonwatt.llm.token_count import slices

#: Words of a block, after which the next begins.
HELD = 1_000_000
#: Distinct words of a block, after which the next begins, and words that a shard may expect.
VOCABULARY = 1 << 18
#: Bigrams that a shard may expect.
BIGRAMS = 1 << 21
#: Places of target documents that are broadcast, 4 bytes each; more are joined by block.
MARKS = 1 << 23
LONGEST = 64
#: Words that the single-word model contributes to a bigram's context, as if counted.
PRIOR = 5.0
#: Ids of the unknown word and of the beginning of a text.
UNKNOWN, BEGIN = 0, 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _step() -> Column:
    """The count ``n`` in eighths of a power of two."""
    return F.floor(F.log2("n") * 8).cast("int")


def least_step(counted: DataFrame, most: int) -> int | None:
    """The least step that at most ``most`` rows reach, from a histogram, so nothing is sorted;
    None where even the highest step has more rows."""
    least, used = None, 0
    for bin_, n in sorted(counted.groupBy(_step().alias("bin")).count().collect(), reverse=True):
        used += n
        if used > most:
            break
        least = bin_
    return least


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the greatest counts ``n``, at most ``most`` of them: all that reach the
    least step which leaves so few. Of a highest step with more rows, the first by count and
    then by the first column."""
    least = least_step(counted, most)
    return counted.where(_step() >= least) if least is not None else counted.orderBy(F.desc("n"), counted.columns[0]).limit(most)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, all their lowest bytes first, compressed."""
    of_bytes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(of_bytes.T.tobytes())


def unpack(packed: pa.BinaryScalar, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _joined(met: Iterable[bytes]) -> bytes:
    """Words, which hold no blank, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(met))


def _split(packed: pa.BinaryScalar) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed.as_py()).split()


class _Numbers(dict):
    """Numbers words from 1 as they are met; 0 is a word that is too long."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONGEST:
            return 0
        self[word] = n = len(self) + 1
        return n


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) in blocks, written: the documents' ids, lengths and word numbers;
    the distinct words by number, with their counts ``n``."""
    most_words, most_distinct = HELD, VOCABULARY

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, numbers, held = _Numbers(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                split = words(text.as_py())
                numbers.append(np.fromiter(map(known.__getitem__, split), np.uint32, len(split)))
                ids.append(doc_id)
                held += len(split) + 1
                if held >= most_words or len(known) >= most_distinct:
                    yield block(known, ids, numbers)
                    known, ids, numbers, held = _Numbers(), [], [], 0
        if ids:
            yield block(known, ids, numbers)

    def block(known: _Numbers, ids: list[pa.Scalar], numbers: list[np.ndarray]) -> pa.RecordBatch:
        lengths, flat = np.array([len(x) for x in numbers], np.int64), np.concatenate(numbers)
        n = np.bincount(flat, minlength=len(known) + 1)
        row = pack(lengths), pack(flat), _joined(known), pack(n[1:]), len(known)
        return pa.record_batch([pa.array([ids], pa.list_(ids[0].type)), *(pa.array([v]) for v in row)], names=names)

    names = ["ids", "lengths", "numbers", "words", "n", "n_distinct"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{kind}>, lengths binary, numbers binary, words binary, n binary, n_distinct bigint"
    return stored(rows.select("doc_id", "text").mapInArrow(cut, schema).withColumn("block", F.monotonically_increasing_id()), "blocks")


def marked(cut: DataFrame, targets: DataFrame) -> DataFrame:
    """The blocks with the places of their target documents, those whose id is in ``targets``
    (target_id). Only ids and places are shuffled."""
    named = cut.select("block", F.posexplode("ids").alias("at", "doc_id"))
    met = named.join(small_side(targets, targets.count()), F.col("doc_id") == F.col("target_id"), "left_semi")
    places = stored(met.groupBy("block").agg(F.collect_list("at").alias("targets")), "targets")
    total = places.agg(F.coalesce(F.sum(F.size("targets")), F.lit(0))).first()[0]
    return cut.join(F.broadcast(places) if total <= MARKS else places, "block", "left")


def _marks(targets: pa.ListScalar, lengths: np.ndarray) -> np.ndarray:
    """Whether each document is a target."""
    out = np.zeros(len(lengths), bool)
    if targets.is_valid:
        out[targets.values.to_numpy(zero_copy_only=False)] = True
    return out


def _places(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct number and where it stands, in order."""
    order = np.argsort(numbers, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
        if len(part):
            yield int(numbers[part[0]]), part


#: Answers of a shard to a block. Of words: their numbers, ids and counts; how many of the shard's
#: words it is the first to name, and how often known words occur in it. Of bigrams: counts alone.
ANSWER = "block bigint, shard bigint, at binary, id binary, n binary, t binary, first bigint, n_own bigint, t_own bigint"


def vocabulary(cut: DataFrame, size: int | None = None) -> DataFrame:
    """Ids from 2 and counts of all words but those that occur once, as answers to the marked blocks,
    written; given ``size``, of the most frequent ones of them. ``n`` counts over all documents,
    ``t`` over the targets."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, n in zip(*batch.columns, strict=True):
                yield pa.record_batch([pa.array(_split(packed), pa.binary()), unpack(n)], names=["word", "n"])

    total = cut.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    shards = total // max(1, VOCABULARY) + 1
    chosen = None
    if size is not None:
        met = cut.select("words", "n").mapInArrow(flat, "word binary, n bigint")
        counted = met.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
        chosen = {bytes(r["word"]) for r in most_frequent(counted, size).select("word").collect()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, n, lengths, numbers, targets in zip(*batch.columns, strict=True):
                met, n, lengths = np.array(_split(packed), object), unpack(n), unpack(lengths)
                of_targets = unpack(numbers, np.uint32)[np.repeat(_marks(targets, lengths), lengths)]
                t = np.bincount(of_targets, minlength=len(met) + 1)[1:]
                shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in met), np.int64, len(met))
                for s, at in _places(shard):
                    row = block.as_py(), s, pack(at + 1), _joined(met[at]), pack(n[at]), pack(t[at])
                    yield pa.record_batch([pa.array([v]) for v in row], names=["block", "shard", "at", "words", "n", "t"])

    def answer(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        lists = [_split(w) for w in rows["words"]]
        coded = pa.array([w for met in lists for w in met], pa.binary()).dictionary_encode()
        word = coded.indices.to_numpy()
        own = [np.concatenate([unpack(x) for x in rows[c]]) for c in ("n", "t")]
        # Sums are whole numbers and exact in doubles up to 2^53.
        n, t = (np.bincount(word, x).astype(np.int64) for x in own)
        known = n > 1
        if chosen is not None:
            known &= np.array([w in chosen for w in coded.dictionary.to_pylist()], bool)
        ids = (np.cumsum(known) - 1) * shards + shard + 2
        if ids.max() >= 1 << 32:
            raise OverflowError("more words than ids of 32 bits")
        first = np.zeros(len(word), bool)
        first[np.unique(word, return_index=True)[1]] = True
        out, start = [], 0
        for block, at, met in zip(rows["block"].to_pylist(), rows["at"], lists, strict=True):
            part = slice(start, start := start + len(met))
            here = known[word[part]]
            w = word[part][here]
            sums = first[part][here].sum(), own[0][part][here].sum(), own[1][part][here].sum()
            out.append((block, shard, pack(unpack(at)[here]), pack(ids[w]), pack(n[w]), pack(t[w]), *map(int, sums)))
        return _answers(out)

    asked = cut.select("block", "words", "n", "lengths", "numbers", "targets").mapInArrow(ask, "block bigint, shard bigint, at binary, words binary, n binary, t binary")
    return stored(asked.groupBy("shard").applyInArrow(answer, ANSWER), "known")


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 3]
    names = [c.split()[0] for c in ANSWER.split(", ")]
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})


@dataclass(frozen=True)
class Totals:
    """Sums over all documents (first) and the targets: words, unknown words, texts with words."""

    words: tuple[int, int]
    unknown: tuple[int, int]
    texts: tuple[int, int]
    n_known: int


def totals(cut: DataFrame, known: DataFrame) -> Totals:
    """Of marked blocks and their vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, targets in zip(*batch.columns, strict=True):
                lengths = unpack(lengths)
                sides = lengths, lengths[_marks(targets, lengths)]
                sums = [x for n in sides for x in (int(n.sum()), int((n > 0).sum()))]
                yield pa.record_batch([pa.array([x]) for x in sums], names=["w0", "d0", "w1", "d1"])

    added = cut.select("lengths", "targets").mapInArrow(add, "w0 bigint, d0 bigint, w1 bigint, d1 bigint")
    w0, d0, w1, d1 = added.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in added.columns]).first()
    n_known, n, t = known.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("first", "n_own", "t_own")]).first()
    return Totals((w0, w1), (w0 - n, w1 - t), (d0, d1), n_known)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shards_of(gram: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and where its bigrams stand in ``gram``, in their order."""
    return _places((_mix(gram) % np.uint64(shards)).astype(np.int64))


def sequences(numbers: np.ndarray, lengths: np.ndarray, begin: int) -> np.ndarray:
    """The number before each word, ``begin`` at the start of a text."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = begin
    return before


@dataclass(frozen=True)
class Block:
    """A block's words with what is known of them, by number; the last number is the beginning."""

    lengths: np.ndarray
    marks: np.ndarray
    word: np.ndarray
    before: np.ndarray
    counts: tuple[np.ndarray, np.ndarray]
    gram: np.ndarray

    @staticmethod
    def read(row: pa.Table, answers: list[dict], whole: Totals) -> Block:
        lengths = unpack(row["lengths"][0])
        marks = _marks(row["targets"][0], lengths)
        word = unpack(row["numbers"][0], np.uint32).astype(np.int64)
        begin = row["n_distinct"][0].as_py() + 1
        ids, counts = np.full(begin + 1, UNKNOWN, np.uint64), tuple(np.full(begin + 1, n) for n in whole.unknown)
        for a in answers:
            at = unpack(a["at"])
            ids[at] = unpack(a["id"])
            for into, c in zip(counts, ("n", "t"), strict=True):
                into[at] = unpack(a[c])
        ids[begin], counts[0][begin], counts[1][begin] = BEGIN, *whole.texts
        before = sequences(word, lengths, begin)
        return Block(lengths, marks, word, before, counts, ids[before] << np.uint64(32) | ids[word])


def _answers_in(table: pa.Table) -> tuple[list[dict], dict[int, dict]]:
    """Those about words, and those about bigrams by shard."""
    rows = [{c: table[c][i] for c in table.column_names} for i in range(table.num_rows)]
    return [r for r in rows if r["at"].is_valid], {r["shard"].as_py(): r for r in rows if not r["at"].is_valid}


def bigrams(cut: DataFrame, known: DataFrame, whole: Totals, shards: int) -> DataFrame:
    """Counts of all bigrams that occur twice, as answers to the blocks, written; the others'
    are 0. A bigram is first id << 32 | second id."""

    def ask(row: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block.read(row, _answers_in(answers)[0], whole)
        gram, n = np.unique(b.gram, return_counts=True)
        target, m = np.unique(b.gram[np.repeat(b.marks, b.lengths)], return_counts=True)
        t = np.zeros(len(gram), np.int64)
        t[np.searchsorted(gram, target)] = m
        out = [(s, pack(np.diff(gram[at], prepend=np.uint64(0))), pack(n[at]), pack(t[at])) for s, at in shards_of(gram, shards)]
        block = pa.array([row["block"][0].as_py()] * len(out), pa.int64())
        kinds = {"shard": pa.int64(), "gram": pa.binary(), "n": pa.binary(), "t": pa.binary()}
        return pa.table({"block": block} | {c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(kinds.items())})

    def answer(rows: pa.Table) -> pa.Table:
        grams = [np.cumsum(unpack(g, np.uint64), dtype=np.uint64) for g in rows["gram"]]
        at = np.unique(np.concatenate(grams), return_inverse=True)[1]
        n, t = (np.bincount(at, np.concatenate([unpack(x) for x in rows[c]])).astype(np.int64) for c in ("n", "t"))
        n, t = np.where(n > 1, n, 0), np.where(n > 1, t, 0)
        parts = np.split(at, np.cumsum([len(g) for g in grams])[:-1])
        where = zip(rows["block"].to_pylist(), rows["shard"].to_pylist(), parts, strict=True)
        return _answers([(b, s, None, None, pack(n[p]), pack(t[p]), None, None, None) for b, s, p in where])

    asked = _met(cut.select("block", "lengths", "targets", "numbers", "n_distinct"), known).applyInArrow(
        ask, "block bigint, shard bigint, gram binary, n binary, t binary"
    )
    return stored(asked.groupBy("shard").applyInArrow(answer, ANSWER), "bigrams")


def _met(cut: DataFrame, answers: DataFrame):  # noqa: ANN202
    return cut.groupBy("block").cogroup(answers.groupBy("block"))


@dataclass(frozen=True)
class Models:
    """The kept ``bigrams`` (first id << 32 | second id), sorted."""

    bigrams: np.ndarray


def models(flagged: DataFrame, vocab: dict[bytes, int], most: int = BIGRAMS) -> Models:
    """The most frequent bigrams of all rows of (text, is_target) over a given vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                ids = [np.array([vocab.get(w, UNKNOWN) for w in words(t.as_py())], np.int64) for t in part.column(0)]
                flat = np.concatenate(ids)
                before = sequences(flat, np.array([len(x) for x in ids]), BEGIN)
                gram, n = np.unique(before << 32 | flat, return_counts=True)
                yield pa.record_batch([gram, n], names=["gram", "n"])

    counted = flagged.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    kept = most_frequent(counted.where("n > 1"), most).select("gram").toArrow()
    return Models(np.sort(kept["gram"].to_numpy()))


def score(docs: DataFrame, targets: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, target_loss, background_loss, score.

    ``targets``: the ids of the target documents, in its first column.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = targets.select(F.col(f"`{targets.columns[0]}`").alias("target_id")).dropna().distinct()
    cut = marked(blocks(rows), ids)
    known = vocabulary(cut)
    whole = totals(cut, known)
    shards = whole.words[0] // max(1, BIGRAMS) + 1
    pairs = bigrams(cut, known, whole, shards)

    def judge(row: pa.Table, answers: pa.Table) -> pa.Table:
        of_words, of_bigrams = _answers_in(answers)
        b = Block.read(row, of_words, whole)
        gram, place = np.unique(b.gram, return_inverse=True)
        some, starts = b.lengths > 0, (np.cumsum(b.lengths) - b.lengths)[b.lengths > 0]
        means = []
        for column, n, total in zip(("n", "t"), b.counts, whole.words, strict=True):
            seen = np.zeros(len(gram))
            for s, at in shards_of(gram, shards):
                seen[at] = unpack(of_bigrams[s][column])
            prior = PRIOR * (n + 1) / (total + whole.n_known + 1)
            loss = np.log(n + PRIOR)[b.before] - np.log(seen[place] + prior[b.word])
            mean = np.zeros(len(some))
            if len(starts):
                mean[some] = np.add.reduceat(loss, starts) / b.lengths[some]
            means.append(mean)
        background, target = (pa.array(m, mask=~some) for m in means)
        ids = row["ids"].combine_chunks().flatten()
        columns = [ids, pa.array(b.lengths), target, background, pa.array(means[1] - means[0])]
        return pa.table(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return _met(cut.select("block", "ids", "lengths", "targets", "numbers", "n_distinct"), known.unionByName(pairs)).applyInArrow(
        judge, f"doc_id {kind}, n_words bigint, target_loss double, background_loss double, score double"
    )
