"""Sharding by best-fit-decreasing bin packing.

Groups of documents that must stay together (copies of one text, so that no
text lands in two shards) are sorted by size; each enters the open shard with
the least room that it fits, found in a balanced tree. One task packs a hash
partition of groups, of a fixed number of shards' bytes; the shards that a
partition leaves unfilled are then packed once more, each as an indivisible group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Bytes of a shard; shards' worth of bytes, and groups, in a partition; unfilled shards that one task packs again; what counts as filled.
CAPACITY, SHARDS_A_TASK, GROUPS_A_TASK, AGAIN_A_TASK, FILLED = 64 << 20, 16, 500_000, 100_000, 0.98


class Room:
    """The open bins by (room, number): a height-balanced (AVL) search tree."""

    def __init__(self) -> None:
        self.root = None  # a node is [key, left, right, height]

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of ``size`` or more."""
        node, best = self.root, None
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = self._remove(self.root, best)
        return best

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _balance(self, node):
        height = self._height
        tilt = height(node[1]) - height(node[2])
        if tilt > 1:
            if height(node[1][1]) < height(node[1][2]):
                node[1] = self._turn(node[1], 2, 1)
            return self._turn(node, 1, 2)
        if tilt < -1:
            if height(node[2][2]) < height(node[2][1]):
                node[2] = self._turn(node[2], 1, 2)
            return self._turn(node, 2, 1)
        node[3] = 1 + max(height(node[1]), height(node[2]))
        return node

    def _turn(self, node, up: int, down: int):
        child = node[up]
        node[up], child[down] = child[down], node
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        child[3] = 1 + max(self._height(child[1]), self._height(child[2]))
        return child

    def _add(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._balance(node)

    def _remove(self, node, key):
        if key < node[0]:
            node[1] = self._remove(node[1], key)
        elif key > node[0]:
            node[2] = self._remove(node[2], key)
        elif node[1] is None or node[2] is None:
            return node[1] or node[2]
        else:
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = self._remove(node[2], least[0])
        return self._balance(node)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size; they must be in falling order. A size over the capacity has a bin of its own."""
    room, out, n = Room(), np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        if size > capacity:
            out[i], n = n, n + 1
            continue
        found = room.take_tightest(size)
        if found is None:
            found, n = (capacity, n), n + 1
        out[i] = found[1]
        room.add((found[0] - size, found[1]))
    return out


def _packed(items: DataFrame, parts: int, capacity: int) -> DataFrame:
    """``(item, size, part, bin)`` from ``(item, size)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            b = pd.concat(got).sort_values(["size", "item"], ascending=[False, True])
            b["bin"] = best_fit_decreasing(b["size"].to_numpy(), capacity)
            yield b

    placed = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    return placed.repartitionById(parts, F.col("part")).mapInPandas(run, "item long, size long, part int, bin long")


def shard(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, group_id, n_bytes, shard)``, one row for each input row.

    Rows of equal text are one group; ``group_id`` is a hash of the text (two
    texts of equal hash would just stay together). A null text has 0 bytes and is
    a group with the rows of the same id and null text. A document takes one byte of a shard at least,
    so that empty ones fill shards too. A group larger than a
    shard has an oversized one to itself. Of groups of equal size the one of least ``group_id`` is placed first.
    Shard numbers are not consecutive. An empty table gives no row.
    """
    group = F.when(F.col("text").isNull(), F.xxhash64("doc_id", F.lit("null"))).otherwise(F.xxhash64("text")).alias("group_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    groups = cut(rows.groupBy("group_id").agg(F.sum(F.greatest("n_bytes", F.lit(1))).alias("size")).withColumnRenamed("group_id", "item"))
    total, n = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    first = cut(_packed(groups, max(1, ceil(total / (SHARDS_A_TASK * capacity)), ceil(n / GROUPS_A_TASK)), capacity))
    bin_id = (F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")).alias("item")
    bins = first.select(bin_id, "size").groupBy("item").agg(F.sum("size").alias("size"))
    unfilled = bins.filter(F.col("size") < int(FILLED * capacity))
    again = _packed(unfilled, max(1, ceil(unfilled.count() / AGAIN_A_TASK)), capacity)
    # Of repacked bins, the shard is numbered below 0.
    moved = again.select(F.col("item").alias("old"), (-1 - F.shiftleft(F.col("part").cast("long"), 32) - F.col("bin")).alias("new"))
    where = first.select(F.col("item").alias("group_id"), bin_id.alias("old")).join(moved, "old", "left").select("group_id", F.coalesce("new", "old").alias("shard"))
    return rows.join(where, "group_id").select("doc_id", "group_id", "n_bytes", "shard")
