"""Mixing sources to target weights.

Each source is cut into blocks of documents in a random order. Its quota is a
number of blocks. A splitting tree hands the quotas to the output shards: the
blocks of a range of shards are divided between its halves by a multivariate
hypergeometric draw, so each shard has an exact number of blocks, and their
sources vary as in a random deal. Shards then draw disjoint runs of each source's
permuted blocks, and shuffle their own documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import ceil, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free, numbered, sent_if_small

#: Documents in a block, documents in a shard, rows in a bucket that one task orders.
BLOCK, SHARD_DOCS, BUCKET_ROWS = 16, 1024, 100_000
#: Without given weights a source weighs its size to this power.
POWER = 0.7


def targets(sizes: Mapping[str | None, int], weights: Mapping[str | None, float] | None = None) -> dict[str | None, int]:
    """Documents to draw from each source: by weight, the most for which none runs out.

    The source that is scarcest for its weight gives all it has. Any source with
    weight gives one document at least.
    """
    w = {s: n**POWER if weights is None else max(0.0, float(weights.get(s, 0.0))) for s, n in sizes.items()}
    level = min((n / w[s] for s, n in sizes.items() if w[s] > 0 and n), default=0.0)
    return {s: min(n, max(1, round(w[s] * level))) if w[s] > 0 else 0 for s, n in sizes.items()}


def quotas(sizes: Mapping[str | None, int], weights: Mapping[str | None, float] | None = None, share: float | None = None, block: int = BLOCK) -> dict[str | None, int]:
    """Blocks to draw from each source.

    They hold the ``targets``, the last not in full. If ``share`` is given, that share
    of all documents is divided by weight instead; a source that has too few
    gives all it has and the others fill in by their weights, so that achieved weights
    may differ. No document is drawn twice. Fractions of blocks go to the largest remainders.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    if share is None:
        docs = targets(sizes, weights)
        return {s: ceil(docs[s] / block) for s in names}
    n = np.array([sizes[s] for s in names], dtype=float)
    w = n**POWER if weights is None else np.array([max(0.0, float(weights.get(s, 0.0))) for s in names])
    limit = np.where(w > 0, np.ceil(n / block), 0)
    want = min(round(share * n.sum() / block + 1e-9) or (1 if n.sum() else 0), limit.sum())
    q, left = np.zeros(len(names)), want
    open_ = limit > 0
    while left > 1e-9 and open_.any():
        step = q + np.where(open_, left * w / w[open_].sum(), 0)
        q = np.minimum(step, limit)
        left = want - q.sum()
        open_ &= q < limit - 1e-12
    whole = np.floor(q + 1e-9)
    short = int(round(want - whole.sum()))
    for i in sorted(range(len(names)), key=lambda i: (-(q[i] - whole[i]), i)):
        if short <= 0:
            break
        if whole[i] < limit[i]:
            whole[i] += 1
            short -= 1
    return dict(zip(names, whole.astype(int).tolist()))


def split(lo: int, hi: int, begin: np.ndarray, have: np.ndarray, total: int, shards: int, seed: int) -> tuple[tuple, tuple]:
    """The two halves of a node of the tree: (first shard, end, first block of each source, blocks of each source).

    Shard i of all gets the blocks from ``i * total // shards``. The draw depends on the node and the seed alone.
    """
    mid = (lo + hi) // 2
    size = mid * total // shards - lo * total // shards
    rng = np.random.default_rng([seed, lo, hi])
    left = rng.multivariate_hypergeometric(have, size, method="marginals") if len(have) else have
    return (lo, mid, begin, left), (mid, hi, begin + left, have - left)


def leaves(node: tuple, total: int, shards: int, seed: int) -> Iterator[tuple]:
    todo = [node]
    while todo:
        lo, hi, begin, have = todo.pop()
        if hi - lo == 1:
            yield lo, begin, have
        else:
            todo += split(lo, hi, begin, have, total, shards, seed)[::-1]


def plan(docs: DataFrame, weights: Mapping[str | None, float] | None = None, share: float | None = None, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = 7) -> DataFrame:
    """``(doc_id, source, shard, position, block)`` of the documents drawn.

    A null source is a source, named None in ``weights``; a null id is an id;
    rows of equal id and source are drawn one by one. There is a row on the driver for each source. Sources give exactly their
    ``targets``; with ``share`` their quotas, from which only the last block of a source,
    which may be short, deviates. An empty table, or weights of 0, draw nothing.
    """
    dealt = _dealt(docs, weights, share, block, shard_docs, seed)
    return dealt.drop("copy")


def _dealt(docs: DataFrame, weights: Mapping[str | None, float] | None = None, share: float | None = None, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = 7) -> DataFrame:
    """``plan``, with the number of each row among those of its id and source."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    drawn = quotas(sizes, weights, share, block)
    docs_of = targets(sizes, weights) if share is None else {s: n * block for s, n in drawn.items()}
    names, total = list(drawn), sum(drawn.values())
    shards = max(1, ceil(total * block / shard_docs))
    spark, rng = docs.sparkSession, np.random.default_rng(seed)

    # Blocks to shards. The top of the tree is split here, the rest by tasks.
    nodes = [(0, shards, np.zeros(len(names), np.int64), np.array([drawn[s] for s in names], dtype=np.int64))]
    while len(nodes) < 64 and any(n[1] - n[0] > 64 for n in nodes):
        nodes = [x for n in nodes for x in (split(*n, total, shards, seed) if n[1] - n[0] > 64 else (n,))]
    tops = spark.createDataFrame([(lo, hi, b.tolist(), h.tolist()) for lo, hi, b, h in nodes], "lo long, hi long, start array<long>, have array<long>")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for shard, start, have in leaves((r.lo, r.hi, np.array(r.start), np.array(r.have)), total, shards, seed):
                    k = np.flatnonzero(have)
                    yield pd.DataFrame({"sid": k, "shard": shard, "start": start[k], "have": have[k]})

    deal = tops.repartition(len(nodes), "lo").mapInPandas(grow, "sid int, shard long, start long, have long")
    deal = deal.select("sid", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("have") - 1)).alias("place"))

    # Documents to blocks: their rank in their source by hash, counted bucket by bucket.
    facts = []
    for i, s in enumerate(names):
        blocks = max(1, ceil(sizes[s] / block))
        step = next(a for a in iter(lambda: int(rng.integers(1, max(2, min(blocks, 1 << 31)))), None) if gcd(a, blocks) == 1)
        shift = (step - 1) % blocks  # the last block, which may be short, has the last place
        facts.append((s, i, max(1, ceil(sizes[s] / BUCKET_ROWS)), blocks, step, shift, docs_of[s]))
    kinds = [("s", pa.string()), ("sid", pa.int32()), *((c, pa.int64()) for c in ("buckets", "blocks", "step", "shift", "quota"))]
    about = spark.createDataFrame(pa.table({c: pa.array([f[i] for f in facts], kind) for i, (c, kind) in enumerate(kinds)}))
    rows = numbered(rows, ["doc_id", "source"], "copy").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    known = rows.join(about, F.col("source").eqNullSafe(F.col("s"))).filter("quota > 0")
    known = known.withColumn("bucket", F.least(F.floor((F.col("h") / F.lit(float(1 << 64)) + 0.5) * F.col("buckets")), F.col("buckets") - 1))
    counts = known.groupBy("sid", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("base"))
    order = Window.partitionBy("sid", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last())
    ranked = known.withColumn("r", F.row_number().over(order)).join(before, ["sid", "bucket"])
    at = F.col("base") + F.col("r") - 1
    ranked = ranked.withColumn("block", F.floor(at / F.lit(block))).withColumn("slot", at % block).withColumn("place", F.pmod(F.col("block") * F.col("step") + F.col("shift"), F.col("blocks")))
    dealt = ranked.filter(F.col("place") * block + F.col("slot") < F.col("quota")).select("doc_id", "source", "copy", "sid", "h", "block", "place").join(deal, ["sid", "place"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "shard", "h"), F.col("doc_id").asc_nulls_last(), "sid")
    return dealt.select("doc_id", "source", "copy", "shard", (F.row_number().over(local) - 1).cast("long").alias("position"), "block")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``plan`` draws, whole, each shard's together and in its order.

    Rows of one id and source, such as those without an id, are drawn in the order of the table and of their
    texts' hashes. Null texts are documents like any other; an empty table stays empty; other columns may have any names.
    """
    i, s, c, shard, place, block, before = free(docs, "id", "source", "copy", "shard", "place", "block", "before")
    drawn = cut(_dealt(docs, **options).select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("copy").alias(c), F.col("shard").alias(shard), F.col("position").alias(place)))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s))
    if drawn.filter(F.col(c) > 0).take(1) or docs.groupBy("doc_id", "source").count().filter("count > 1").take(1):
        # The rows of repeated ids are numbered block by block of the table, so that no task holds all of one id.
        repeated = docs.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s)).count().filter("count > 1").drop("count")
        often = cut(docs.join(repeated, same, "left_semi").withColumn(block, F.floor(F.monotonically_increasing_id() / F.lit(float(BUCKET_ROWS)))))
        counts = often.groupBy("doc_id", "source", block).count()
        counts = counts.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col(block).alias(f"{block}2"), (F.sum("count").over(Window.partitionBy("doc_id", "source").orderBy(block)) - F.col("count")).alias(before))
        often = often.withColumn(c, F.row_number().over(Window.partitionBy("doc_id", "source", block).orderBy(F.xxhash64("text"))) - 1)
        often = often.join(counts, same & (F.col(block) == F.col(f"{block}2"))).withColumn(c, F.col(c) + F.col(before)).select(*docs.columns, c)
        numbers = docs.join(repeated, same, "left_anti").withColumn(c, F.lit(0).cast("long")).unionByName(often)
    else:
        numbers = docs.withColumn(c, F.lit(0).cast("long"))
    out = numbers.withColumnRenamed(c, f"{c}2").join(sent_if_small(drawn), same & (F.col(f"{c}2") == F.col(c)))
    return out.repartition(F.col(shard)).sortWithinPartitions(shard, place).select(*docs.columns)
