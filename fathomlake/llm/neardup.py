"""Near-duplicates by DartMinHash.

A document is a weighted set of word shingles, the weight of a shingle being
how often it occurs. Darts are thrown, by hashing, into the region of each
element (weight by rank, one expected dart per unit of area): those below the
element's weight and below a rank that depends on the total weight are kept,
and the dart of least rank in each of ``DARTS`` coordinates is the signature.
Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity, and an element of a long document costs few darts.
Signatures are joined by bands. In a bucket each member is verified against the least one on the whole
signatures, one comparison for each distinct pair however many buckets have it; only what
that leaves unlinked is compared with the rest of its bucket, in blocks. Documents linked by
verified pairs form groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, forget, free, sent_if_small
from .text import chunks, mix64, shingles, tokens

#: Coordinates of a signature; rows of a band; words of a shingle; similarity that makes a pair.
DARTS, ROWS, WIDTH, LEAST = 256, 4, 3, 0.45
BANDS = DARTS // ROWS
#: Characters that a text counts as at least when texts are signed together: darts take as much memory for a short one.
LEAST_CHARS = 256
#: Members of a bucket, or of a block of a larger one, that a task holds.
BLOCK = 2000
_ELEMENT_BITS = 44
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407))
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(12)])


def weighted_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: number of the text, element (44 bits), weight."""
    words, bounds = tokens(texts, signs=False)
    h, doc = shingles(words, bounds, width)
    key = (doc.astype(np.uint64) << np.uint64(_ELEMENT_BITS)) | (h >> np.uint64(64 - _ELEMENT_BITS))
    key, weight = np.unique(key, return_counts=True)
    return (key >> np.uint64(_ELEMENT_BITS)).astype(np.int64), key & np.uint64((1 << _ELEMENT_BITS) - 1), weight.astype(float)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, t: int = DARTS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (uint64, one row a document) and which documents have one (those with an element).

    The elements must be in the order of documents. A coordinate holds its least
    dart as rank and fingerprint. Where the rank limit left one empty, the
    document is done again with twice the limit.
    """
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n)
    limit = (np.log(t) + 2) * t / np.maximum(total, 1e-300)
    has = total > 0
    todo = has.copy()
    while todo.any():
        pick = todo[doc]
        d, e, w = doc[pick], element[pick], weight[pick]
        # One cell for each started unit of weight, then for each started unit of rank.
        cells = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(d)), cells)
        unit = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        h = mix64(e[at] * _A + unit.astype(np.uint64) * _B)
        bands = np.ceil(limit[d[at]]).astype(np.int64)
        again = np.repeat(np.arange(len(at)), bands)
        level = np.arange(len(again)) - np.repeat(np.cumsum(bands) - bands, bands)
        h = mix64(h[again] + level.astype(np.uint64) * _C)
        thrown = np.searchsorted(_POISSON, (h >> np.uint64(11)) * 2.0**-53, side="right")
        hit = np.repeat(np.arange(len(h)), thrown)
        dart = np.arange(len(hit)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        v = mix64(h[hit] + (dart.astype(np.uint64) + np.uint64(1)) * _D)
        back = again[hit]
        own = d[at[back]]
        rank = level[hit] + (v >> np.uint64(11)) * 2.0**-53
        height = unit[back] + (mix64(v ^ _A) >> np.uint64(11)) * 2.0**-53
        kept = (rank < limit[own]) & (height < w[at[back]])
        own, rank, v = own[kept], rank[kept], mix64(v[kept] ^ _B)
        packed = ((rank * 2.0**20).astype(np.uint64) << np.uint64(24)) | (v & np.uint64(0xFFFFFF))
        np.minimum.at(out, own * t + (v >> np.uint64(24)).astype(np.int64) % t, packed)
        full = (out.reshape(n, t) != np.iinfo(np.uint64).max).all(axis=1)
        todo = has & ~full
        limit = limit * 2
    return out.reshape(n, t), has


def _sign(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: hash of the signature, the signature in 16 bits each; whether it has one."""
    sig, has = signatures(*weighted_sets(texts), len(texts))
    sig = mix64(sig)
    whole = mix64(mix64(sig + np.arange(DARTS, dtype=np.uint64) * _A).sum(axis=1, dtype=np.uint64))
    return whole.view(np.int64), (sig & np.uint64(0xFFFF)).astype("<u2"), has


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, node, sig)`` of the rows with a word; ``body`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for begin, end in chunks(texts, least=LEAST_CHARS):
                whole, sig, has = _sign(texts[begin:end])
                kept = pa.array(has)
                ids = [c.slice(begin, end - begin).filter(kept) for c in b.columns[:2]]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(whole[has]), pa.array([s.tobytes() for s in sig[has]], pa.binary())], names=["doc_id", "body", "node", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text").filter("text is not null")
    return rows.mapInArrow(run, "doc_id long, body long, node long, sig binary")


def link(sigs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of rows that connect all rows linked by a similarity of ``least`` or more.

    Each row is compared to all later ones that are not already in its group,
    so the groups are those of all pairs, while a bucket of like documents
    costs as many comparisons as it has rows.
    """
    n = len(sigs)
    group = np.arange(n)
    out = []
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not len(rest):
            if i == 0 or (group == group[0]).all():
                break
            continue
        like = rest[(sigs[rest] == sigs[i]).mean(axis=1) >= least]
        for j in like.tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), "<u2").reshape(-1, DARTS)


def _edges(sketches: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` links between signature nodes, verified, from every bucket with two nodes or more.

    Buckets with the same members, as like documents share many, are looked at once: they are known
    by number, least member and a checksum (nodes are hashes), so that no bucket is gathered for it.
    """
    nodes = cut(sketches.groupBy("node").agg(F.first("sig").alias("sig")))
    keys = F.array(*[F.xxhash64(F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS), F.lit(i)) for i in range(BANDS)])
    slots = nodes.select("node", F.explode(keys).alias("band"))
    buckets = slots.groupBy("band").agg(F.min("node").alias("lo"), F.bit_xor("node").alias("sum"), F.count("*").alias("n")).filter("n > 1")
    buckets = cut(buckets.groupBy("n", "lo", "sum").agg(F.min("band").alias("band")).select("band", "n", "lo"))
    members = cut(slots.join(sent_if_small(buckets), "band").select("band", "n", "lo", "node"))
    pairs = cut(members.filter("node <> lo").select("lo", "node").distinct())
    nodes = cut(nodes.join(sent_if_small(cut(members.select("node").distinct())), "node", "left_semi"))
    pairs = pairs.join(nodes.withColumnRenamed("sig", "sig_b"), "node").join(nodes.select(F.col("node").alias("lo"), F.col("sig").alias("sig_a")), "lo")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                like = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(like)], names=["a", "b", "linked"])

    verified = cut(pairs.select("lo", "node", "sig_a", "sig_b").mapInArrow(verify, "a long, b long, linked boolean"))
    stars = verified.filter("linked").select("a", "b")
    # Members that the least one of their bucket is unlike. With two members there is no more to compare.
    left = members.filter("n > 2").join(verified.filter("not linked").select(F.col("a").alias("lo"), F.col("b").alias("node")), ["lo", "node"])
    left = cut(left.select("band", "n", "node"))
    most = left.agg(F.max("n")).first()[0]
    if most is None:
        return stars
    unclear = left.groupBy("band").agg(F.count("*").alias("rest"))
    full = members.join(unclear, "band").join(nodes, "node")
    small = full.filter(F.col("n") <= BLOCK).groupBy("band").agg(F.collect_list("node").alias("nodes"), F.collect_list("sig").alias("sigs"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for nodes, sigs in zip(b.column(0).to_pylist(), b.column(1)):
                for i, j in link(_matrix(sigs.values), least):
                    a.append(nodes[i])
                    c.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    found = stars.union(small.select("nodes", "sigs").mapInArrow(within, "a long, b long"))
    if most <= BLOCK:
        return found.filter("a <> b")

    # A larger bucket: blocks of the members that are left, each against all blocks of the bucket.
    large = full.filter(F.col("n") > BLOCK).join(left.select("band", "node", F.lit(True).alias("alone")), ["band", "node"], "left")

    def block(size: str, seed: int) -> F.Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col(size) / BLOCK)).alias("block")

    held = [F.collect_list("node").alias("nodes"), F.collect_list("sig").alias("sigs")]
    whole = large.groupBy("band", block("n", 1)).agg(*held, F.collect_list(F.coalesce("alone", F.lit(False))).alias("alone"))
    rest = large.filter("alone").groupBy("band", block("rest", 2)).agg(*held)
    both = rest.select("band", F.col("nodes").alias("a"), F.col("sigs").alias("sa")).join(whole.select("band", F.col("nodes").alias("b"), F.col("sigs").alias("sb"), "alone"), "band")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, c = [], []
            for nodes, sigs, others, theirs, alone in zip(*(t.column(i) for i in range(5))):
                for i, j in link_to(_matrix(sigs.values), _matrix(theirs.values), alone.values.to_numpy(zero_copy_only=False), least):
                    a.append(nodes[i].as_py())
                    c.append(others[j].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return found.union(both.select("a", "sa", "b", "sb", "alone").mapInArrow(between, "a long, b long")).filter("a <> b")


def link_to(rest: np.ndarray, block: np.ndarray, alone: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a row of ``rest`` and one of ``block`` that connect all which a similarity of ``least`` links.

    Rows of the block that are not ``alone`` are linked to each other already, so one of them is enough for a row.
    """
    out = []
    for i, row in enumerate(rest):
        like = np.flatnonzero((block == row).mean(axis=1) >= least)
        known = like[~alone[like]]
        out += [(i, int(j)) for j in (*known[:1], *like[alone[like]])]
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of an edge ``(a, b)``: the least node connected to it.

    Large-star and small-star steps in turn until nothing changes; each round is
    kept in the shared folder, so no lineage grows, and the one before is removed.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x"))
        old, e = e, cut(small.select("x.a", "x.b").filter("a <> b").distinct())
        forget(old)
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now


def grouped(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``(doc_id, body, keep_id, keep_body)`` of the rows in a group of two or more, one row each.

    The kept member is the one of least ``doc_id`` (null orders last), of these the one of least ``body``.
    """
    sketches = cut(sketch(docs))
    roots = components(_edges(sketches, least))
    rows = sketches.select("doc_id", "body", "node").join(roots, "node", "left").select("doc_id", "body", F.coalesce("root", "node").alias("root"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    kept = rows.groupBy("root").agg(F.min(first).alias("k"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(kept, "root").select("doc_id", "body", F.col("k.doc_id").alias("keep_id"), F.col("k.body").alias("keep_body"))


_SPARED = "doc_id <=> keep_id and body = keep_body"


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``(doc_id, keep_id)`` for each document that a group of near-duplicates can do without.

    ``keep_id`` is the group's least ``doc_id``, null only if none has one. Exact copies are near-duplicates.
    A text of fewer words than a shingle is one shingle. Rows whose text is
    null or has no word are in no group; rows of equal id and text (or of no id and equal text)
    are one document. No bucket and no table of pairs is capped. An empty table gives no row.
    """
    return grouped(docs, least).filter(f"not ({_SPARED})").select("doc_id", "keep_id").distinct()


def drop_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, whole, without those that ``near_copies`` would name, and one of each document that is repeated.

    Rows without a word stay, repeated or not; an empty table stays empty; other columns may have any names.
    """
    i, b, h, r = free(docs, "id", "body", "hash", "row")
    g = cut(grouped(docs, least))
    gone = sent_if_small(cut(g.filter(f"not ({_SPARED})").select(F.col("doc_id").alias(i), F.col("body").alias(b)).distinct()))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(b))
    out = hashed.join(gone, same, "left_anti")
    twice = g.filter(_SPARED).groupBy(F.col("doc_id").alias(i), F.col("body").alias(b)).count().filter("count > 1").drop("count")
    if twice.take(1):
        first = out.join(twice, same, "left_semi").withColumn(r, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(h))).filter(F.col(r) == 1).drop(r)
        out = out.join(twice, same, "left_anti").unionByName(first)
    return out.select(*docs.columns)
