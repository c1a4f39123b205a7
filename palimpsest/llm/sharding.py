"""Operator 8, sharding: Karmarkar-Karp differencing balances bytes over shards while groups stay whole."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.tables import q, read
from palimpsest.shared import cut

SHARDS, FAN = 64, 2048


def differencing(vectors: np.ndarray, leave: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combine n partial partitions (rows of k sums) until ``leave`` of them are left.

    The two of the largest spread are combined again and again, one by falling and the other by rising sums, so that
    large meets small; those left have small spreads and can still even out others. Returns the sums of those left,
    and for each input which of them it is part of and to which of its slots each slot of the input went.
    """
    n, k = vectors.shape
    sums = {i: vectors[i] for i in range(n)}
    heap = [(-int(s), i) for i, s in enumerate(vectors.max(axis=1) - vectors.min(axis=1))]
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    top = n
    while len(heap) > leave:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        out = sums.pop(a)[down] + sums.pop(b)[up]
        joins.append((a, b, down, up))
        sums[top] = out
        heapq.heappush(heap, (-int(out.max() - out.min()), top))
        top += 1
    left = sorted(sums)
    slot, part = np.empty((top, k), np.int64), np.empty(top, np.int64)
    slot[left], part[left] = np.arange(k), np.arange(len(left))
    for at in range(len(joins) - 1, -1, -1):  # from the last join down to the inputs
        a, b, down, up = joins[at]
        slot[a][down] = slot[n + at]
        slot[b][up] = slot[n + at]
        part[a] = part[b] = part[n + at]
    return np.stack([sums[i] for i in left]), part[:n], slot[:n]


def _node(vectors: np.ndarray, node: int, keep: int, leave: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(parent, sums, slots) of a node's inputs; the sums of a parent stand beside the first of its inputs only."""
    sums, part, slot = differencing(vectors, leave)
    listed: list[list[int] | None] = [None] * len(part)
    for i, first in zip(*np.unique(part, return_index=True)):
        listed[first] = sums[i].tolist()
    return pa.array(node * keep + part), pa.array(listed, pa.list_(pa.int64())), slot


def _leaves(k: int, keep: int, leave: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("bytes", "descending"), ("g", "ascending")])
        v = np.zeros((len(t), k), np.int64)
        v[:, 0] = t.column("bytes").to_numpy()
        parent, sums, slot = _node(v, t.column("node")[0].as_py(), keep, leave)
        return pa.Table.from_arrays([t.column("g"), parent, pa.array(slot[:, 0]), sums], ["g", "parent", "slot", "sums"])

    return run


def _inner(k: int, keep: int, leave: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("child", "ascending")])
        v = t.column("sums").combine_chunks().values.to_numpy().reshape(-1, k)
        parent, sums, slot = _node(v, t.column("node")[0].as_py(), keep, leave)
        return pa.Table.from_arrays([t.column("child"), parent, pa.array(slot.tolist(), pa.list_(pa.int64())), sums], ["child", "parent", "moves", "sums"])

    return run


def shard_groups(groups: DataFrame, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """(g, shard) of each row (g long, bytes long): a tree of differencing steps over nodes of about ``fan`` inputs.

    A node stops at a sixteenth of its inputs. Its results are partial partitions of small spread, on which the next
    level goes on with those of other nodes, until one node takes all that are left. So no task sees more than a few
    times ``fan`` inputs however many groups there are, and large groups are evened out by small ones of all nodes.
    """
    keep = max(2, fan // 16)
    width = max(1, -(-groups.count() // fan))
    leave = keep if width > 1 else 1
    level = cut(groups.withColumn("node", F.pmod(F.xxhash64("g"), F.lit(width))).groupBy("node").applyInArrow(_leaves(shards, keep, leave), "g long, parent long, slot long, sums array<long>"))
    leaves, moves = level.select("g", "parent", "slot"), []
    while width > 1:
        width = max(1, -(-width * keep // fan))
        leave = keep if width > 1 else 1
        inputs = level.where("sums is not null").select(F.col("parent").alias("child"), "sums").withColumn("node", F.pmod(F.xxhash64("child"), F.lit(width)))
        level = cut(inputs.groupBy("node").applyInArrow(_inner(shards, keep, leave), "child long, parent long, moves array<long>, sums array<long>"))
        moves.append(level.select("child", F.col("parent").alias("up"), "moves"))
    for m in moves:  # where the slots of partial partitions went, level by level
        leaves = leaves.join(m, leaves["parent"] == m["child"]).select("g", F.col("up").alias("parent"), F.col("moves")[F.col("slot").cast("int")].alias("slot"))
    return leaves.select("g", F.col("slot").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, group_cols: tuple[str, ...] = ("text",), text_col: str = "text", id_col: str = "doc_id", fan: int = FAN) -> DataFrame:
    """(id, shard, bytes) of each row of ``docs``: shards of nearly equal bytes, rows alike in ``group_cols`` in one shard.

    By default copies of one text stay together. Only ids, 8-byte group keys and lengths move, never texts.

    Nulls in the group columns equal each other, so such rows form groups as well; a null text has 0 bytes; a null id
    is carried as null. Repeated rows are each assigned (to the shard of their group). Ties in size go by group key.
    Two groups whose 64-bit keys agree share a shard. An empty table gives no rows. Other columns are left aside.
    """
    key = F.xxhash64(F.lit("g"), *[q(c) for c in group_cols])
    rows = docs.select(q(id_col).alias(id_col), key.alias("g"), F.coalesce(F.octet_length(q(text_col)), F.lit(0)).cast("long").alias("bytes"))
    placed = shard_groups(cut(rows.groupBy("g").agg(F.sum("bytes").alias("bytes"))), shards, fan)
    return rows.join(placed, "g").select(q(id_col).alias(id_col), "shard", "bytes")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard(read(spark, sf_dir, "documents"))
