"""Packing documents into training windows.

Non-negative least squares on the histogram of lengths: all combinations of at
most three lengths that fill a window are enumerated, the number of repeats of
each is solved for against the histogram, rounded, and carried out; what is
left is packed greedily, the longest first into the fullest window that it fits.

Lengths are UTF-8 bytes, the tokens of a byte-level model. A shard of rows, its
size fixed, is packed by one task, so there is no global order or counter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .shared import numbered

#: Bytes in a window; lengths are rounded up to one of so many steps; rows in a shard.
WINDOW, STEPS, SHARD_ROWS = 8192, 128, 50_000


@functools.lru_cache(maxsize=4)
def combinations(steps: int) -> np.ndarray:
    """Every way to fill ``steps`` with at most three parts, one in a row, unused parts 0."""
    out = [(0, 0, steps)] + [(0, a, steps - a) for a in range(1, steps // 2 + 1)]
    out += [(a, b, steps - a - b) for a in range(1, steps // 3 + 1) for b in range(a, (steps - a) // 2 + 1)]
    return np.array(out)


@functools.lru_cache(maxsize=4)
def _matrix(steps: int) -> tuple[np.ndarray, np.ndarray]:
    c = combinations(steps)
    a = np.zeros((steps + 1, len(c)))
    for part in c.T:
        np.add.at(a, (part, np.arange(len(c))), 1.0)
    a = a[1:]
    return a, a.T @ a


def nnls(a: np.ndarray, gram: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """The x >= 0 of least ``|a x - b|``, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free, ab = np.zeros(n), np.zeros(n, bool), a.T @ b
    limit = tolerance * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):
        w = ab - gram @ x
        w[free] = -np.inf
        j = int(w.argmax())
        if not w[j] > limit:
            break
        free[j] = True
        while True:
            k = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, k], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[k] = s
                break
            bad = s <= 0
            xk = x[k]
            step = float(np.min(xk[bad] / np.maximum(xk[bad] - s[bad], 1e-300)))
            x[k] = xk + step * (s - xk)
            gone = k[x[k] <= 1e-12]
            x[gone] = 0
            free[gone] = False
            if j in gone and step == 0:
                break
    return x


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, steps: int = STEPS) -> np.ndarray:
    """The number of the window of each length in 1..window. Equal input gives equal output."""
    unit = window / steps
    size = np.clip(np.ceil(lengths / unit).astype(np.int64), 1, steps)
    order = np.lexsort((np.arange(len(lengths)), -lengths, size))
    counts = np.bincount(size, minlength=steps + 1)
    first = np.cumsum(counts) - counts
    taken = np.zeros(steps + 1, np.int64)
    out = np.empty(len(lengths), np.int64)
    combos = combinations(steps)
    a, gram = _matrix(steps)
    repeats = np.rint(nnls(a, gram, counts[1:].astype(float))).astype(np.int64)
    n = 0
    for c in np.argsort(-repeats, kind="stable"):
        if repeats[c] <= 0:
            break
        parts, need = np.unique(combos[c][combos[c] > 0], return_counts=True)
        times = int(min(repeats[c], ((counts[parts] - taken[parts]) // need).min()))
        if times <= 0:
            continue
        for p, k in zip(parts, need):
            at = first[p] + taken[p] + np.arange(times * k)
            out[order[at]] = n + np.arange(times * k) % times
            taken[p] += times * k
        n += times
    rest = [order[first[p] + taken[p] : first[p] + counts[p]] for p in range(steps, 0, -1)]
    room: list[list[int]] = [[] for _ in range(steps + 1)]  # windows by their free steps
    for p, members in zip(range(steps, 0, -1), rest):
        for i in members.tolist():
            free = next((r for r in range(p, steps + 1) if room[r]), None)
            if free is None:
                w, free, n = n, steps, n + 1
            else:
                w = room[free].pop()
            room[free - p].append(w)
            out[i] = w
    return out


SCHEMA = StructType([StructField(n, LongType()) for n in ("doc_id", "piece", "start", "length", "pack_id", "offset")])


def pack(docs: DataFrame, window: int = WINDOW, steps: int = STEPS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, piece, start, length, pack_id, offset)``: which bytes of a text lie where in which window.

    A text longer than a window is cut into pieces, all of them packed; as lengths are bytes, a cut may
    lie inside a character, whose bytes then follow in the next piece. Null and
    empty texts have one piece of length 0 with a null ``pack_id``. Repeated rows
    and null ids are packed like any other row; rows of equal id and length are interchangeable.
    An empty table gives no row.
    """
    n_shards = max(1, ceil(docs.count() / shard_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    rows = numbered(rows, ["doc_id", "n"], "copy").select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", "copy"), F.lit(n_shards)).cast("int").alias("shard"))
    arrow = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        t = t.sort_by([("n", "descending"), ("doc_id", "ascending")])
        n, shard = t.column("n").to_numpy(), int(t.column("shard")[0].as_py())
        pieces = np.maximum(1, -(-n // window))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * window
        length = np.minimum(n[row] - start, window)
        full = np.flatnonzero(length > 0)
        pack_of = np.full(len(row), -1, np.int64)
        pack_of[full] = pack_lengths(length[full], window, steps)
        order = np.lexsort((np.arange(len(row)), pack_of))
        before = np.cumsum(length[order]) - length[order]
        head = np.append(True, np.diff(pack_of[order]) != 0)
        offset = np.empty(len(row), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(head, before, 0))
        empty = pack_of < 0
        columns = [t.column("doc_id").take(pa.array(row)).combine_chunks(), pa.array(piece), pa.array(start), pa.array(length),
                   pa.array((shard << 32) + pack_of, mask=empty), pa.array(offset, mask=empty)]
        out = pa.Table.from_arrays([c.cast(pa.int64()) for c in columns], schema=arrow)
        yield from out.to_batches(max_chunksize=50_000)

    return rows.repartitionById(n_shards, F.col("shard")).mapInArrow(run, SCHEMA)
