"""Stability of distributions over time: the population stability index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ordering import FEW, quantiles, quantiles_of_values, sums_before

#: Shares of 0 count as this, or as a millionth of the least other share if that is greater.
EPSILON = 1e-4


@dataclass(frozen=True)
class Stability:
    threshold: float = 0.2
    least_intervals: int = 10
    most_intervals: int | None = 12
    n_bins: int = 10
    top_share: float = 0.7
    statistic: str = "max"


def statistic(name: str) -> Callable[[Sequence[float]], float]:
    """max, min, mean, or a quantile such as q75 (the next value above)."""
    if name.startswith("q") and name[1:].isdigit():
        q = int(name[1:]) / 100
        return lambda xs: sorted(xs)[math.ceil(q * (len(xs) - 1))]
    return {"max": max, "min": min, "mean": lambda xs: sum(xs) / len(xs)}[name]


def filled(shares: Sequence[float]) -> list[float]:
    least = min((s for s in shares if s), default=EPSILON)
    low = EPSILON if least <= EPSILON else least / 10**6
    return [s or low for s in shares]


def index(reference: Sequence[float], current: Sequence[float]) -> float:
    """The stability index of two lists of shares of the same bins."""
    return sum((r - c) * math.log(r / c) for r, c in zip(filled(reference), filled(current)))


def intervals(df: DataFrame, date: str, n: int) -> Column:
    """The interval of a row by quantiles of the dates, equal edges merged; the earliest is 0."""
    t = F.unix_micros(F.col(date).cast("timestamp"))
    inner = sorted(set(quantiles(df, t, [i / n for i in range(n + 1)])))[1:-1]
    out: Column = F.lit(0)
    for e in inner:
        out = out + F.when(t > e, 1).otherwise(0)
    return out


def feature_psi(df: DataFrame, features: Sequence[str], date: str, categorical: Sequence[str] = (), params: Stability = Stability(), presence: Sequence[str] = ()) -> dict[str, float | None]:
    """The index of each feature between the earliest interval of time and the others, aggregated.

    Numbers with more than 20 values in the first interval are binned by its
    quantiles; of other features the values count whose frequency is in the
    upper part by rank. Null is a bin. Whether the columns ``presence`` are null is looked at in the same pass, named
    ``<column> is present``. Up to ``FEW`` counts are ranked and compared by the driver; more where they are, and the driver
    gets an index for each feature and interval. Features without two intervals have None.
    """
    rows = df.filter(F.col(date).isNotNull())
    months = rows.agg(F.count_distinct(F.month(F.col(date).cast("timestamp")))).first()[0]
    n = max(params.least_intervals, months)
    n = min(n, params.most_intervals) if params.most_intervals else n
    looks = {f: F.col(f) for f in features} | {f"{c} is present": F.col(c).isNotNull() for c in presence}
    rows = rows.select(intervals(rows, date, n).alias("part"), *[c.alias(f"f{i}") for i, c in enumerate(looks.values())])
    first, edges = rows.filter("part = 0"), {}
    for i, f in enumerate(features):
        if f not in categorical and isinstance(df.schema[f].dataType, NumericType):
            values, found = quantiles_of_values(first, F.col(f"f{i}").cast("double"), [k / params.n_bins for k in range(params.n_bins + 1)])
            if values > 20:
                edges[f] = found[1:-1]
    cells = []
    for i, f in enumerate(looks):
        c = F.col(f"f{i}")
        cells.append(F.struct(F.lit(i).alias("f"), (F.when(c.isNotNull(), _reached(c, edges[f]).cast("string")) if f in edges else c.cast("string")).alias("value")))
    counts = rows.select("part", F.explode(F.array(*cells)).alias("c")).groupBy("part", "c.f", "c.value").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    parts: dict[int, dict[int, float]] = {i: {} for i in range(len(looks))}
    few = counts.limit(FEW + 1).collect()
    if len(few) <= FEW:
        tables: dict[int, dict[int, dict[str | None, int]]] = {i: {} for i in range(len(looks))}
        for r in few:
            tables[r.f].setdefault(r.part, {})[r.value] = r.n
        parts = {i: _index_by_part(tables[i], f in edges, params) for i, f in enumerate(looks)}
    else:
        for r in _indices(counts, [i for i, f in enumerate(looks) if f in edges], params).collect():
            parts[r.f][r.part] = r.psi
    counts.unpersist()
    return {f: statistic(params.statistic)([parts[i][p] for p in sorted(parts[i])]) if parts[i] else None for i, f in enumerate(looks)}


def _index_by_part(parts: dict[int, dict[str | None, int]], binned: bool, params: Stability) -> dict[int, float]:
    """The index of each interval after the first."""
    if 0 not in parts:
        return {}
    values = [str(i) for i in range(params.n_bins)] if binned else _frequent(parts, params.top_share)

    def shares(p: int) -> list[float]:
        n = sum(parts[p].values())
        return [parts[p].get(v, 0) / n for v in [*values, None]]

    first = shares(0)
    return {p: index(first, shares(p)) for p in sorted(parts) if p}


def _frequent(parts: dict[int, dict[str | None, int]], share: float) -> list[str]:
    """Values whose average rank by total count is in the upper part."""
    total = Counter()
    for counts in parts.values():
        total.update({v: n for v, n in counts.items() if v is not None})
    sizes, rank, below = Counter(total.values()), {}, 0
    for n in sorted(sizes):
        rank[n] = (below + (sizes[n] + 1) / 2) / len(total)
        below += sizes[n]
    return sorted(v for v, n in total.items() if rank[n] >= share)


def _indices(counts: DataFrame, binned: Sequence[int], params: Stability) -> DataFrame:
    """``(f, part, psi)`` of each interval after the first, from ``(part, f, value, n)``."""
    is_binned = F.col("f").isin(list(binned)) if binned else F.lit(False)
    total = counts.filter("value is not null").groupBy("f", "value").agg(F.sum("n").alias("total"))
    # Rank by total: from how many values have each total, which are few.
    sizes = total.groupBy("f", "total").agg(F.count("*").alias("k"))
    by = Window.partitionBy("f")
    rank = (F.sum("k").over(by.orderBy("total")) - F.col("k") + (F.col("k") + 1) / 2) / F.sum("k").over(by)
    sizes = sizes.withColumn("rank", rank)
    kept = total.join(sizes, ["f", "total"]).filter(is_binned | (F.col("rank") >= params.top_share)).select("f", "value")
    bins = counts.filter(is_binned).select("f").distinct().select("f", F.explode(F.array(*[F.lit(str(i)) for i in range(params.n_bins)])).alias("value"))
    there = counts.groupBy("f", "part").agg(F.sum("n").alias("all"))
    null = there.select("f", F.lit(None).cast("string").alias("value")).distinct()
    values = kept.filter(~is_binned).unionByName(bins).unionByName(null)
    grid = values.join(there, "f")  # a row for each value and interval, of which there are a dozen
    same = (F.col("c.f") == F.col("g.f")) & (F.col("c.part") == F.col("g.part")) & F.col("c.value").eqNullSafe(F.col("g.value"))
    shares = grid.alias("g").join(counts.alias("c"), same, "left").select("g.f", "g.part", "g.value", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"))
    least = shares.filter("share > 0").groupBy("f", "part").agg(F.min("share").alias("least"))
    low = F.when(F.coalesce("least", F.lit(EPSILON)) <= EPSILON, EPSILON).otherwise(F.col("least") / 10**6)
    shares = shares.join(least, ["f", "part"], "left").select("f", "part", "value", F.when(F.col("share") > 0, F.col("share")).otherwise(low).alias("share"))
    before, after = shares.filter("part = 0").select("f", "value", F.col("share").alias("r")), shares.filter("part > 0").withColumnRenamed("share", "s")
    pairs = after.alias("a").join(before.alias("b"), (F.col("a.f") == F.col("b.f")) & F.col("a.value").eqNullSafe(F.col("b.value")))
    return pairs.groupBy("a.f", "a.part").agg(F.sum((F.col("r") - F.col("s")) * F.ln(F.col("r") / F.col("s"))).alias("psi"))


def _reached(c: Column, edges: Sequence[float]) -> Column:
    """How many of the edges a value reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: c >= e))


def with_nulls(df: DataFrame, features: Sequence[str]) -> list[str]:
    nulls = df.agg(*[F.count(F.when(F.col(f).isNull(), 1)).alias(f"n{i}") for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if nulls[f"n{i}"]]


def sparsity_psi(df: DataFrame, features: Sequence[str], date: str, params: Stability = Stability()) -> dict[str, float | None]:
    """The index of whether each feature with nulls is present."""
    sparse = with_nulls(df, features)
    got = feature_psi(df, [], date, params=params, presence=sparse) if sparse else {}
    return {f: got[f"{f} is present"] for f in sparse}


def unstable(df: DataFrame, features: Sequence[str], date: str, categorical: Sequence[str] = (), params: Stability = Stability()) -> list[str]:
    """Features whose index, of values or of presence, is above the threshold."""
    got = feature_psi(df, features, date, categorical, params, with_nulls(df, features))
    return [f for f in features if (got.get(f) or 0) > params.threshold or (got.get(f"{f} is present") or 0) > params.threshold]


def target_psi(expected: DataFrame, actual: DataFrame, target: str) -> DataFrame:
    """``psi`` of a target over two bins that halve the range of both tables."""
    both = expected.select(F.col(target).cast("double").alias("t"), F.lit(0).alias("side")).unionByName(actual.select(F.col(target).cast("double").alias("t"), F.lit(1).alias("side")))
    both = both.filter("t is not null")
    mid = both.agg(((F.min("t") + F.max("t")) / 2).alias("mid"))
    high = both.crossJoin(F.broadcast(mid)).select("side", (F.col("t") > F.col("mid")).cast("double").alias("h"))
    s = high.agg(F.avg(F.when(F.col("side") == 0, F.col("h"))).alias("e"), F.avg(F.when(F.col("side") == 1, F.col("h"))).alias("a"))
    term = lambda e, a: (e - a) * F.when((e > 0) & (a > 0), F.ln(e / F.nullif(a, F.lit(0.0)))).otherwise(F.lit(0.0))
    e, a = F.col("e"), F.col("a")
    return s.select((term(e, a) + term(1 - e, 1 - a)).alias("psi"))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> float:
    """The greatest gap between the distribution functions of a column in two tables."""
    x = F.col(column).cast("double")
    both = a.select(x.alias("x"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).unionByName(b.select(x.alias("x"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))
    values = both.filter("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    all_ = values.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = sums_before(values, "x", ["a", "b"]).select((F.col("a_before") + F.col("a")).alias("ca"), (F.col("b_before") + F.col("b")).alias("cb")).crossJoin(F.broadcast(all_))
    return gap.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")))).first()[0] or 0.0


def ks_p_value(d: float, n: int, m: int) -> float:
    """The asymptotic probability of a gap of ``d`` or more between samples of one distribution."""
    root = math.sqrt(n * m / (n + m))
    t = (root + 0.12 + 0.11 / root) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))))
