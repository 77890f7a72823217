"""Nearest neighbours, approximately, of a set of vectors among all.

A hierarchical k-means tree is searched best bin first: a priority queue holds
the nodes seen so far by the distance of their centres; the nearest is opened
next, which brings its children into the queue, and leaves are compared in full. The
number of leaves that a query visits is widened until the recall on a sample of
queries, against exact search, reaches the target; recall is measured with that number before
it is used.

The tree is fitted on a bounded sample and holds every vector. Its size is bounded
by the sample, so it can be sent to all tasks. Where a table outgrows it, a leaf is cut into
pieces of a fixed number of vectors, and the task that searches a piece grows a tree of
its own in it, searched in the same way. A task holds one piece and a batch of queries.
Vectors that repeat are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Vectors that the tree is fitted on, at most about; of these in a leaf, at least; vectors in a leaf, about; children of a node; Lloyd steps.
FIT, LEAST_FIT, LEAF, FAN, STEPS = 131_072, 32, 512, 8, 4
#: Vectors in a piece; queries of a leaf that one task answers; queries that a task holds candidates of at a time.
PIECE, ASKED_A_TASK, ASKED = 65_536, 65_536, 2048
#: Queries of the calibration, and the recall they must have. Queries are the vectors whose id is divisible by EVERY.
SAMPLE, TARGET, EVERY = 256, 0.93, 20


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None]
    return np.maximum(d, 0)


@dataclass
class Tree:
    """Nodes in arrays: centre and children."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=lambda: [[]])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf node that each vector descends to."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                at[rows] = node
                continue
            near = _squared(x[rows], self.centres[kids]).argmin(axis=1)
            todo += [(c, rows[near == j]) for j, c in enumerate(kids)]
        return at

    def best_first(self, x: np.ndarray, visits: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[list[int]]:
        """The leaves that each vector visits, in order: ``visits`` of them if there are so many.

        Opening a node computes the distances of its children only. With ``sizes`` of leaves, empty
        ones don't count and it goes on in any case until it has seen ``least`` vectors.
        """
        out, children = [], self.children
        if not children[0]:
            return [[0]] * len(x)
        block = {n: self.centres[kids] for n, kids in enumerate(children) if kids}
        for q in x:
            heap, seen, lacking = [(0.0, 0)], [], least
            while heap and (len(seen) < visits or lacking > 0):
                node = heapq.heappop(heap)[1]
                if kids := children[node]:
                    away = block[node] - q
                    for d, c in zip(np.einsum("ij,ij->i", away, away).tolist(), kids):
                        heapq.heappush(heap, (d, c))
                elif sizes is None or sizes.get(node):
                    seen.append(node)
                    lacking -= sizes[node] if sizes else 0
            out.append(seen)
        return out

    @property
    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``k`` distinct starting centres, drawn as k-means++ does."""
    out = [x[rng.integers(len(x))]]
    d = _squared(x, out[0][None])[:, 0]
    while len(out) < k and d.sum() > 1e-9:
        out.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, _squared(x, out[-1][None])[:, 0])
    return np.array(out)


def local_tree(x: np.ndarray, leaf: int = LEAF, seed: int = 7) -> tuple[Tree, np.ndarray]:
    """A tree over vectors in memory, and the leaf of each. Equal vectors share a leaf, however many."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, dtype=np.float64)
    centres, children, at = [x.mean(axis=0)], [[]], np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        own = x[rows]
        c = seeds(own, int(min(FAN, max(2, -(-len(rows) // leaf)))), rng)
        for _ in range(STEPS):
            near = _squared(own, c).argmin(axis=1)
            n = np.bincount(near, minlength=len(c))
            c = np.array([own[near == j].mean(axis=0) if n[j] else c[j] for j in range(len(c))])
        near = _squared(own, c).argmin(axis=1)
        used = np.unique(near)
        if len(used) < 2:
            continue
        for j in used:
            centres.append(c[j])
            children.append([])
            children[node].append(len(centres) - 1)
            at[rows[near == j]] = len(centres) - 1
            todo.append((len(centres) - 1, rows[near == j]))
    return Tree(np.array(centres, dtype=np.float32), children), at


@dataclass
class Piece:
    """Vectors in memory, in the order of their ids, and the tree over them."""

    ids: np.ndarray
    x: np.ndarray
    tree: Tree
    rows_of: dict[int, np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 7) -> Piece:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        tree, at = local_tree(x, leaf, seed) if len(x) > leaf else (Tree(x[:1]), np.zeros(len(x), np.int64))
        return cls(ids, x, tree, {node: np.flatnonzero(at == node) for node in tree.leaves})

    def search(self, q: np.ndarray, names: np.ndarray, k: int, visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, squared distance) of up to ``k`` vectors for each query; none has the query's name."""
        parts = [self._some(q[s : s + ASKED], names[s : s + ASKED], k, visits) for s in range(0, len(q), ASKED)]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        who = np.concatenate([p[0] + i * ASKED for i, p in enumerate(parts)])
        return who, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def _some(self, q: np.ndarray, names: np.ndarray, k: int, visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by_leaf: dict[int, list[int]] = {}
        for i, seen in enumerate(self.tree.best_first(q, visits, {n: len(r) for n, r in self.rows_of.items()}, k + 1)):
            for node in seen:
                by_leaf.setdefault(node, []).append(i)
        found: list[tuple[np.ndarray, ...]] = []
        for node, queries in by_leaf.items():
            rows, own = self.rows_of[node], np.array(queries)
            for s in range(0, len(own), step := max(1, (1 << 21) // max(1, len(rows)))):
                part = own[s : s + step]
                d = _squared(q[part], self.x[rows])
                d[names[part][:, None] == self.ids[rows][None]] = np.inf
                m = min(k, len(rows))
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                last = np.take_along_axis(d, near, axis=1).max(axis=1)
                for i in np.flatnonzero((d <= last[:, None]).sum(axis=1) > m):  # a tie at the end: the lesser ids win
                    near[i] = np.argsort(d[i], kind="stable")[:m]
                at, who = rows[near.ravel()], np.repeat(part, m)
                away = q[who].astype(np.float64) - self.x[at]
                exactly = np.einsum("ij,ij->i", away, away)
                exactly[self.ids[at] == names[who]] = np.inf
                found.append((who, self.ids[at], exactly))
        who, ident, dist = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ident, dist, who))
        who, ident, dist = who[order], ident[order], dist[order]
        head = np.append(True, who[1:] != who[:-1])
        place = np.arange(len(who)) - np.maximum.accumulate(np.where(head, np.arange(len(who)), 0))
        kept = (place < k) & np.isfinite(dist)
        return who[kept], ident[kept], dist[kept]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(id, v)`` with one vector for each id, as 32-bit floats; their dimension, 0 if there are none.

    Left out are rows with a null id, a null vector or a null, NaN or infinite
    entry, and those whose dimension is not the most frequent one (the least of
    equally frequent ones). Of several vectors of an id the least counts.
    """
    ok = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).filter("id is not null and v is not null and size(v) > 0").filter(ok)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows, 0
    return cut(rows.filter(F.size("v") == common.d).groupBy("id").agg(F.min("v").alias("v"))), common.d


def fit(rows: DataFrame, n: int, dim: int, leaf: int = LEAF, sample: int = FIT, seed: int = 7) -> Tree:
    """The tree, from about ``sample`` vectors, chosen by a hash of their ids, or all if there are fewer.

    A leaf is to hold ``leaf`` of all vectors, but ``LEAST_FIT`` of the sample.
    """
    some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < sample)
    got = some.orderBy("id").select("v").toArrow().column("v").combine_chunks()
    x = _vectors(got, dim)
    return local_tree(x, max(LEAST_FIT if n > sample else 1, round(leaf * len(x) / n)), seed)[0]


def exact(cells: DataFrame, queries: pd.DataFrame, k: int, dim: int) -> pd.DataFrame:
    """The ``k`` nearest of each query, by comparing it to every vector: ``(q, id, cell, d)``."""
    q, names = np.stack(queries["v"].to_numpy()).astype(np.float32), queries["id"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, ids, cell = _vectors(b.column(2), dim), b.column(1).to_numpy(), b.column(0).to_numpy()
                d = _squared(q, x)
                d[names[:, None] == ids[None]] = np.inf
                m = min(k, d.shape[1])
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                at = near.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(names, m), ids[at], cell[at], np.take_along_axis(d, near, axis=1).ravel().astype(float))], names=["q", "id", "cell", "d"])

    near = cells.mapInArrow(run, "q long, id long, cell long, d double").filter("d < double('Infinity')")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).filter(F.col("r") <= k).drop("r").toPandas()


@dataclass
class Search:
    """All vectors by leaf of the tree, ready for queries."""

    cells: DataFrame
    sizes: dict[int, int]
    tree: Tree
    dim: int
    k: int
    leaf: int = LEAF
    piece: int = PIECE
    seed: int = 7

    def found(self, queries: DataFrame, visits: int, inner: int) -> DataFrame:
        """``(q, id, d)``: up to ``k`` others for each query ``(id, v)``, from ``visits`` leaves and ``inner`` leaves of each piece."""
        tree, sizes, k, dim, leaf, seed = self.tree, self.sizes, self.k, self.dim, self.leaf, self.seed

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen = tree.best_first(_vectors(b.column(1), dim), visits, sizes, k + 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seen, pa.list_(pa.int64()))], names=["id", "v", "cells"])

        routed = queries.select("id", "v").mapInArrow(route, "id long, v array<float>, cells array<long>")
        # Pieces of a leaf, and parts of its queries, that have a task of their own.
        pieces = {c: -(-n // self.piece) for c, n in self.sizes.items() if n > self.piece}
        asked = routed
        many: dict[int, int] = {}
        if queries.count() > ASKED_A_TASK:  # else no leaf can have more
            many = {r.cell: -(-r.n // ASKED_A_TASK) for r in routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > ASKED_A_TASK).collect()}

        def number(of: dict[int, int]) -> F.Column:
            return F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("cell")], F.lit(1)) if of else F.lit(1)

        own = F.pmod(F.xxhash64("id", F.lit(seed)), number(pieces)).cast("int").alias("piece")
        data = self.cells.select("cell", own, F.explode(F.sequence(F.lit(0), number(many) - 1)).alias("part"), F.lit(0).alias("kind"), "id", "v")
        asked = asked.select(F.explode("cells").alias("cell"), "id", "v")
        asked = asked.select("cell", F.explode(F.sequence(F.lit(0), number(pieces) - 1)).alias("piece"), F.pmod(F.xxhash64("id"), number(many)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "v")
        both = data.unionByName(asked).repartition("cell", "piece", "part").sortWithinPartitions("cell", "piece", "part", "kind", "id")

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held, index = None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                keys = np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)])
                ids, x = b.column(4).to_numpy(), _vectors(b.column(5), dim)
                heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
                for s, e in zip(heads, np.append(heads[1:], len(keys))):
                    key = tuple(keys[s, :3])
                    if key != group:
                        group, held, index = key, [], None
                    if keys[s, 3] == 0:
                        held.append((ids[s:e], x[s:e]))
                    elif held:
                        index = index or Piece.of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), leaf, seed)
                        who, ident, dist = index.search(x[s:e], ids[s:e], k, inner)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][who]), pa.array(ident), pa.array(dist.astype(float))], names=["q", "id", "d"])

        near = both.mapInArrow(sweep, "q long, id long, d double")
        return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).filter(F.col("r") <= k).drop("r")

    def calibrate(self, queries: DataFrame, target: float) -> tuple[int, int]:
        """The leaves to visit, and those in each piece, with which the sample's measured recall is ``target``."""
        asked = queries.toPandas()
        true = exact(self.cells, asked, self.k, self.dim)
        if not len(true):
            return len(self.sizes), 1 << 30
        order = {i: {leaf: at for at, leaf in enumerate(seen)} for i, seen in zip(asked["id"], self.tree.best_first(np.stack(asked["v"].to_numpy()), len(self.tree.children), self.sizes))}
        met = np.sort([order[q][c] for q, c in zip(true["q"], true["cell"])]) + 1
        nested = max(self.sizes.values()) > self.leaf
        visits = int(met[int(np.ceil((1 - (1 - target) / (2 if nested else 1)) * len(met))) - 1])
        inner, last = 4, {q: d for q, d in true.groupby("q")["d"].max().items()}
        while True:
            got = self.found(queries, visits, inner).toPandas()
            recall = float((got["d"] <= got["q"].map(last) * (1 + 1e-5) + 1e-6).sum()) / len(true)
            if recall >= target or visits >= len(self.sizes) and (not nested or inner * self.leaf >= 16 * self.piece):
                return visits, inner
            visits, inner = (min(len(self.sizes), -(-visits * 5 // 4)) if not nested or inner * self.leaf >= self.piece else visits), inner * 2


def neighbours(
    vectors: DataFrame, k: int = 10, every: int = EVERY, target: float = TARGET, leaf: int = LEAF, sample: int = SAMPLE,
    fitted: int = FIT, piece: int = PIECE, seed: int = 7,
) -> DataFrame:
    """``(vec_id, neighbor_id, rank, distance)``: the ``k`` nearest others of the vectors whose id is divisible by ``every``.

    Distance is Euclidean. All vectors that ``prepared`` admits are searched; of the others, and of an empty
    table, there is no row. Of equal distances the lesser id comes first. Vectors
    equal to the query's are its neighbours like any other.
    """
    rows, dim = prepared(vectors)
    schema = "vec_id long, neighbor_id long, rank int, distance double"
    # One of each distinct vector, the one of least id, is searched.
    ones = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("times")).select("id", "v", "times")) if dim else rows
    n, repeated = (ones.agg(F.count("*"), F.count(F.when(F.col("times") > 1, 1))).first()) if dim else (0, 0)
    if not n or n < 2 and not repeated:
        return vectors.sparkSession.createDataFrame([], schema)
    tree = fit(ones.select("id", "v"), n, dim, leaf, fitted, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(_vectors(b.column(1), dim))), *b.columns], names=["cell", "id", "v"])

    cells = cut(ones.select("id", "v").mapInArrow(place, "cell long, id long, v array<float>"))
    search = Search(cells, dict(map(tuple, cells.groupBy("cell").count().collect())), tree, dim, k, leaf, piece, seed)
    # Each vector's stand-in; of a repeated one the k + 1 of least id, more of which no query needs.
    asking = rows.filter(F.col("id") % every == 0)
    names, twins = asking.select("id", F.col("id").alias("one")), None
    if repeated:
        again = ones.filter("times > 1").select(F.col("id").alias("one"), "v")
        twins = cut(rows.join(again, "v").select("id", "one"))
        names = asking.join(twins.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("id", F.coalesce("one", "id").alias("one"))
        names = cut(names)
        asking = ones.join(names.select(F.col("one").alias("id")).distinct(), "id", "left_semi")
    asking = cut(asking.select("id", "v"))
    chosen = asking.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    visits, inner = search.calibrate(chosen, target) if n > 1 else (1, 1)
    near = search.found(asking, visits, inner)
    if not repeated:
        result = near.select(F.col("q").alias("vec_id"), F.col("id").alias("neighbor_id"), "d")
    else:
        near = near.unionByName(asking.select(F.col("id").alias("q"), "id", F.lit(0.0).alias("d")))
        few = twins.withColumn("r", F.row_number().over(Window.partitionBy("one").orderBy("id"))).filter(F.col("r") <= k + 1).select("one", F.col("id").alias("twin"))
        near = near.join(few, F.col("id") == F.col("one"), "left").select("q", F.coalesce("twin", "id").alias("neighbor_id"), "d")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "neighbor_id"))).filter(F.col("r") <= k + 1)
        result = names.join(near, F.col("one") == F.col("q")).filter("id <> neighbor_id").select(F.col("id").alias("vec_id"), "neighbor_id", "d")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "neighbor_id"))
    return result.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", F.sqrt("d").alias("distance"))
