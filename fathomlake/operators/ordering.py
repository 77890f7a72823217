"""Running sums and numbers in a global order, without one task that sees all rows.

Rows are split into ranges of the key at approximate quantiles. Totals of the
ranges are few and are summed in order; within a range a window does the rest.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free

#: Rows that one task orders, about; ranges at most, which are longer then.
RANGE_ROWS, MOST_RANGES = 1_000_000, 4096
#: Rows of counts that the driver takes, at most.
FEW = 50_000


def _reached(key: Column, cuts: Sequence[object]) -> Column:
    """How many of the rising cuts a key is above: looked up among every 64th, then among the 64 before the next."""
    if len(cuts) <= 16:
        return reduce(lambda a, b: a + b, [F.when(key > F.lit(c), 1).otherwise(0) for c in cuts], F.lit(0))
    above = lambda array: F.coalesce(F.size(F.filter(array, lambda c: c < key)), F.lit(0))
    blocks = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    block = above(F.array(*[F.lit(b[0]) for b in blocks])) - 1
    within = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.greatest(block, F.lit(0)) + 1)
    return F.when(key.isNull() | (block < 0), 0).otherwise(block * 64 + above(within))


def ranged(df: DataFrame, key: Column, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the number of each row's range; keys of a lower range are less. Null keys come first."""
    n = min(MOST_RANGES, max(1, -(-df.count() // rows)))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * MOST_RANGES)).first()[0] if n > 1 else []
    return df.withColumn(name, _reached(key, list(dict.fromkeys(cuts or []))))


def cumulated(df: DataFrame, order: Sequence[Column], values: Mapping[str, Column], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with sums, by name, of values over all rows before each in ``order``.

    The order must tell all rows apart, or equal rows be alike; its first column, a number or a time, rising, makes the ranges.
    """
    r, *helpers = free(df, wanted="_range " + " ".join(f"_t{i} _l{i}" for i in range(len(values))))
    totals, locals_ = helpers[::2], helpers[1::2]
    parts = ranged(df, order[0], r, rows)
    sums = parts.groupBy(r).agg(*[F.sum(v).alias(t) for v, t in zip(values.values(), totals)])
    earlier = Window.orderBy(r).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = sums.select(r, *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(t) for t in totals])
    local = Window.partitionBy(r).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({c: F.coalesce(F.sum(v).over(local), F.lit(0)) for v, c in zip(values.values(), locals_)})
    joined = parts.join(F.broadcast(starts), r)
    return joined.select(*df.columns, *[(F.col(t) + F.col(c)).alias(n) for n, t, c in zip(values, totals, locals_)])


def sums_before(df: DataFrame, key: str, values: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``df``, one row for a key, with ``<value>_before``: the sum over all lesser keys."""
    return cumulated(df, [F.col(key)], {f"{v}_before": F.col(v) for v in values}, rows)


def numbered(df: DataFrame, order: Sequence[Column], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Consecutive numbers from 0 in ``order``; the first ordering column, rising, makes the ranges."""
    out = cumulated(df, order, {name: F.lit(1)}, rows)
    return out.withColumn(name, F.col(name).cast("long"))


def average_ranks(df: DataFrame, column: str, rank: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``(column, rank)``: the rank of each value among all rows, ties sharing the average."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    return sums_before(counts, column, ["_c"], rows).select(column, (F.col("_c_before") + (F.col("_c") + 1) / 2.0).alias(rank))


def _of_counts(counts: Sequence[tuple[float, int]], shares: Sequence[float]) -> list[float]:
    """Interpolated quantiles of rising values and how often each occurs."""
    if not counts:
        return []
    ends = list(accumulate(c for _, c in counts))
    at = lambda i: counts[bisect_right(ends, i)][0]
    places = [(ends[-1] - 1) * s for s in shares]
    return [at(math.floor(x)) + (at(math.ceil(x)) - at(math.floor(x))) * (x - math.floor(x)) for x in places]


def quantiles(df: DataFrame, column: Column, shares: Sequence[float], rows: int = RANGE_ROWS) -> list[float]:
    """Exact quantiles, interpolated, of a numeric column; empty without a value. No task holds all values."""
    return quantiles_of_values(df, column, shares, rows)[1]


def quantiles_of_values(df: DataFrame, column: Column, shares: Sequence[float], rows: int = RANGE_ROWS) -> tuple[int, list[float]]:
    """The number of distinct values, and exact quantiles as ``quantiles`` gives them.

    Up to ``FEW`` distinct values are counted by the driver. More are counted once where they are; the counts are
    kept on the executors' disks meanwhile, and computed again where one is lost.
    """
    counts = df.filter(column.isNotNull()).groupBy(column.alias("_v")).agg(F.count("*").alias("_c")).persist(StorageLevel.DISK_ONLY)
    try:
        few = counts.limit(FEW + 1).collect()
        if len(few) <= FEW:
            return len(few), _of_counts(sorted(((float(r["_v"]), r["_c"]) for r in few), key=lambda v: (math.isnan(v[0]), v[0])), shares)  # NaN last, as in Spark
        placed = sums_before(counts, "_v", ["_c"], rows)
        values, n = counts.agg(F.count("*"), F.sum("_c")).first()
        if not n:
            return 0, []
        at = [(n - 1) * s for s in shares]
        wanted = sorted({math.floor(x) for x in at} | {math.ceil(x) for x in at})
        hit = F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("_c_before")) & (w < F.col("_c_before") + F.col("_c")))
        found = placed.filter(hit).collect()
        value = {w: float(r["_v"]) for r in found for w in wanted if r["_c_before"] <= w < r["_c_before"] + r["_c"]}
        return values, [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for x in at]
    finally:
        counts.unpersist()
