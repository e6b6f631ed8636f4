"""Prefix trie of conversations by vertical bitmaps.

Turns become digests with the length of their text, so no text is shuffled. Conversations are
dealt into shards of consecutive ids. A shard numbers its conversations and keeps, for every
(position, turn), the bitset of the conversations that have this turn there. A depth-first
walk starts at the full bitset; a node's bitset met with the postings of the next position
gives its children, their popcounts are the members, and what ends at the node's depth is
its list of ends. Every local node carries the chained digest of its turns.

Local nodes of all shards meet by that digest: members add up, the smallest conversation
names the node. The shard that holds this conversation owns the node and also holds all of
its ancestors, so sums over subtrees are sums over owned nodes, first inside the shards
(a subtree is a run of the walk's order) and then over them. No step goes level by level.

Lists of ends are hashed while they stream by in order of the shards: memory does not grow
with them, though each list's hash is one task's work.

Defined results: a null role or text is empty. Rows without a conversation id belong to no
conversation. Turns of one number go by the digest of their contents; repeated rows are
turns of their own. A conversation's turns end in one task, as digests. No conversation
gives no nodes. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noonwatt.llm.common import stored, text_or_empty

#: Turns of a task, and conversations of a shard: the bits of its bitsets.
TASK_TURNS = 50_000
SHARD = 2048
_SHARDS_OF_A_TASK = 1 << 24


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """(conv_id, pos, key, chars): turns numbered from 1, their digests, code points of the text."""
    said, by = text_or_empty(text), text_or_empty(role)
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        # The length of the role tells where it ends.
        F.unhex(F.sha2(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said), 256)).alias("key"),
        F.char_length(said).cast("bigint").alias("chars"),
    )
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "key", "chars")


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


class Shard:
    """The trie of some conversations, given in ascending order of their ids."""

    def __init__(self, conversations: list[tuple[int, list[bytes], list[int]]]):
        self.ids = [c[0] for c in conversations]
        self.keys = [c[1] for c in conversations]
        self.chars = [c[2] for c in conversations]
        self.postings: dict[tuple[int, bytes], int] = defaultdict(int)
        self.ends: dict[int, int] = defaultdict(int)
        for i, keys in enumerate(self.keys):
            self.ends[len(keys)] |= 1 << i
            for at, key in enumerate(keys):
                self.postings[at, key] |= 1 << i

    def nodes(self) -> dict[str, list]:
        """Columns of the nodes in the order of the walk; ``last`` is where a subtree ends."""
        out: dict[str, list] = {name: [] for name in _NODE if name != "shard"}
        waiting = [((1 << len(self.ids)) - 1, 0, -1, hashlib.sha256().digest(), 0)] if self.ids else []
        while waiting:
            members, depth, parent, digest, chars = waiting.pop()
            at = len(out["node"])
            ended = members & self.ends[depth]
            first = (members & -members).bit_length() - 1
            row = {
                "node": at, "last": at, "parent": parent, "digest": digest, "depth": depth,
                "conv_id": self.ids[first], "members": members.bit_count(), "ended": ended.bit_count(),
                "chars": chars, "ends": ",".join(str(self.ids[i]) for i in _bits(ended)),
            }
            for name, value in row.items():
                out[name].append(value)
            rest = members & ~ended
            while rest:
                i = (rest & -rest).bit_length() - 1
                key = self.keys[i][depth]
                child = rest & self.postings[depth, key]
                rest &= ~child
                chained = hashlib.sha256(digest + key).digest()
                waiting.append((child, depth + 1, at, chained, self.chars[i][depth]))
        last, parent = out["last"], out["parent"]
        for at in range(len(last) - 1, 0, -1):
            last[parent[at]] = max(last[parent[at]], last[at])
        return out


_NODE = {
    "shard": pa.int64(), "node": pa.int64(), "last": pa.int64(), "parent": pa.int64(), "digest": pa.binary(),
    "depth": pa.int64(), "conv_id": pa.int64(), "members": pa.int64(), "ended": pa.int64(),
    "chars": pa.int64(), "ends": pa.string(),
}
_NODE_DDL = (
    "shard bigint, node bigint, last bigint, parent bigint, digest binary, depth bigint, conv_id bigint, "
    "members bigint, ended bigint, chars bigint, ends string"
)


def local_nodes(rows: DataFrame, task_turns: int = TASK_TURNS, shard: int = SHARD) -> DataFrame:
    """Nodes of the tries of all shards. ``rows``: (conv_id, pos, key, chars); a row without a
    key only names its conversation."""
    rows = stored(rows, "turns")
    tasks = max(1, math.ceil(rows.count() / task_turns))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * _SHARDS_OF_A_TASK
        held: list[tuple[int, list[bytes], list[int]]] = []

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal number
            columns = Shard(held).nodes()
            columns["shard"] = [number] * len(columns["node"])
            number += 1
            held.clear()
            whole = pa.RecordBatch.from_pydict({n: pa.array(columns[n], t) for n, t in _NODE.items()})
            for start in range(0, whole.num_rows, 10_000):
                yield whole.slice(start, 10_000)

        for batch in batches:
            for conv, key, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "chars"))):
                if not held or held[-1][0] != conv:
                    if len(held) == shard:
                        yield from built()
                    held.append((conv, [], []))
                if key is not None:
                    held[-1][1].append(key)
                    held[-1][2].append(chars)
        if held:
            yield from built()

    dealt = rows.repartitionByRange(tasks, "conv_id").sortWithinPartitions("conv_id", "pos")
    return stored(dealt.mapInArrow(walk, _NODE_DDL), "nodes")


def _subtree_sums(part: pd.DataFrame) -> pd.DataFrame:
    """Sums of one shard over what it owns, per local node."""
    part = part.sort_values("node", ignore_index=True)
    own = (part["first"] == part["conv_id"]).to_numpy()
    last, parent = part["last"].to_numpy(), part["parent"].to_numpy()

    def below(value: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(np.where(own, value, 0))])
        return upto[last + 1] - upto[:-1]

    leaf = (part["n_convs"] == part["n_ends"]).to_numpy().astype(np.int64)
    saved = ((part["n_convs"] - 1) * part["chars"]).to_numpy()
    inner = own & (parent >= 0)
    named = pd.Series(part["first"].to_numpy()[parent]).astype("Int64").where(inner)
    return part[["digest", "depth", "first", "n_convs"]].assign(
        n_leaves=below(leaf),
        saved_tokens=below(saved),
        n_children=np.bincount(parent[inner], minlength=len(part)),
        parent_conv_id=named,
    )


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per digest over its lists, which follow each other in order."""
    current, running = None, None
    for batch in batches:
        digests, hashes = [], []
        for digest, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != current:
                if current is not None:
                    digests.append(current)
                    hashes.append(running.hexdigest())
                current, running = digest, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ends.encode())
        yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(hashes, pa.string())],
                              names=["digest", "ends_sha256"])
    if current is not None:
        yield pa.record_batch([pa.array([current], pa.binary()), pa.array([running.hexdigest()])],
                              names=["digest", "ends_sha256"])


def trie(rows: DataFrame, task_turns: int = TASK_TURNS, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``rows`` as for ``local_nodes``."""
    local = local_nodes(rows, task_turns, shard)
    whole = local.groupBy("digest").agg(
        F.min("conv_id").alias("first"), F.sum("members").alias("n_convs"), F.sum("ended").alias("n_ends")
    )
    placed = local.select("shard", "node", "last", "parent", "digest", "depth", "conv_id", "chars").join(whole, "digest")
    summed = placed.groupBy("shard").applyInPandas(
        _subtree_sums,
        "digest binary, depth bigint, first bigint, n_convs bigint, n_leaves bigint, saved_tokens bigint, "
        "n_children bigint, parent_conv_id bigint",
    )
    nodes = summed.groupBy("digest", "depth", "first", "n_convs").agg(
        F.max("parent_conv_id").alias("parent_conv_id"),  # only the owner names it
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
    )
    # Ranges of ids do not overlap: any member's id puts the shards in order.
    lists = local.where("ended > 0").select("digest", "ends", "conv_id").repartition("digest")
    hashed = lists.sortWithinPartitions("digest", "conv_id").select("digest", "ends").mapInArrow(
        _hash_ends, "digest binary, ends_sha256 string"
    )
    return nodes.join(hashed, "digest", "left").select(
        F.col("first").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
