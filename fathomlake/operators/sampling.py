"""Repeatable samples, balanced classes, recent windows of time series, and folds.

What is random follows from a hash of the row id and a seed, so it does not
depend on partitions and needs no collected state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free
from .ordering import cumulated

SEED = 42
#: Rows of a class that one task orders, about.
SLICE_ROWS = 1_000_000


def draw(row_id: str, seed: int = SEED) -> Column:
    """A number from the row id, to order rows at random."""
    return F.xxhash64(F.col(row_id), F.lit(seed))


def sample(df: DataFrame, n: int, row_id: str, seed: int = SEED) -> DataFrame:
    """``n`` rows, or all if there are fewer."""
    return df.orderBy(draw(row_id, seed), row_id).limit(n)


def capped(df: DataFrame, target: str, caps: Mapping[object, int], row_id: str, seed: int = SEED) -> DataFrame:
    """At most ``caps[class]`` rows of each class; classes that are not named keep all."""
    if not caps:
        return df
    cap: Column = F.lit(None).cast("long")
    for value, most in caps.items():
        cap = F.when(F.col(target) == F.lit(value), F.lit(int(most))).otherwise(cap)
    some = df.filter(F.col(target).isin(list(caps)))
    # The draw is even, so equal slices of it have about equally many rows: a class is ordered slice by slice.
    part, place, n, first, c = free(df, wanted="_part _place _n _first _class")
    slices: Column = F.lit(1)
    for value, count in class_counts(some, target):
        slices = F.when(F.col(target) == F.lit(value), F.lit(-(-count // SLICE_ROWS))).otherwise(slices)
    some = some.withColumn(part, F.floor((draw(row_id, seed) / F.lit(float(1 << 64)) + 0.5) * slices))
    sizes = some.groupBy(F.col(target).alias(c), part).agg(F.count("*").alias(n))
    sizes = sizes.withColumn(first, F.sum(n).over(Window.partitionBy(c).orderBy(part)) - F.col(n))
    local = F.row_number().over(Window.partitionBy(target, part).orderBy(draw(row_id, seed), row_id))
    some = some.withColumn(place, local).join(sizes.withColumnRenamed(part, f"{part}2"), (F.col(target) == F.col(c)) & (F.col(part) == F.col(f"{part}2")))
    limited = some.filter(F.col(first) + F.col(place) <= cap).select(*df.columns)
    return limited.unionByName(df.filter(~F.coalesce(F.col(target).isin(list(caps)), F.lit(False))))


def class_counts(df: DataFrame, target: str) -> list[tuple[object, int]]:
    """Classes by falling count, ties by value."""
    got = df.filter(F.col(target).isNotNull()).groupBy(target).count().orderBy(F.desc("count"), target).collect()
    return [(r[0], r[1]) for r in got]


def balance(df: DataFrame, target: str, task: str, row_id: str, seed: int = SEED, binary_rows: int = 5000, binary_times: int = 5, multi_rows: int = 25_000, multi_times: int = 2) -> DataFrame:
    """Frequent classes cut to a multiple of the rarest.

    Binary, from ``binary_rows`` rows on: five times the minority, filled up to
    those rows. Multiclass: classes below 0.01 %, but for the two largest, go first. With fewer than two classes,
    as in an empty table, nothing changes.
    """
    counts = class_counts(df, target)
    n = sum(c for _, c in counts)
    if len(counts) < 2:
        return df
    if task == "MULTICLASS":
        rare = [v for v, c in counts[2:] if c / n < 0.0001]
        if rare:
            df = df.filter(~F.col(target).isin(rare))
            counts = [(v, c) for v, c in counts if v not in rare]
            n = sum(c for _, c in counts)
        least, k = counts[-1][1], len(counts)
        if n <= multi_rows or counts[0][1] <= multi_times * least:
            return df
        most = multi_times * (least + max((multi_rows - k * least) / (k - 1), 0))
        return capped(df, target, {v: int(min(c, most)) for v, c in counts[:-1]}, row_id, seed)
    if n <= binary_rows or len(counts) < 2:
        return df
    least = counts[-1][1]
    return capped(df, target, {counts[0][0]: min(counts[0][1], binary_times * (least + max(binary_rows - 2 * least, 0)))}, row_id, seed)


#: Rows of a training sample that is forced; distances, by the usual gap of dates, to which series are cut in turn, and the gap in seconds that parts the two lists.
FORCED_ROWS = 7000
HIGH_FREQUENCY, LOW_FREQUENCY, FREQUENT = ("2 years 6 months", "2 years 7 days"), ("7 years", "5 years"), 28 * 86_400


def forced_sample(df: DataFrame, target: str, task: str, row_id: str, rows: int = FORCED_ROWS, date: str | None = None, ids: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """A training sample of about ``rows`` rows, of a larger table; a smaller one stays whole.

    With a ``date`` the rows are those of ``sample_series``. Two classes are balanced: up to half of the rows are of the rarer one,
    the rest of the other. Otherwise rows are drawn at random.
    """
    if df.count() <= rows:
        return df
    if date is not None:
        return sample_series(df, ids, date, rows, seed)
    counts = class_counts(df, target) if task == "BINARY" else []
    if len(counts) != 2:
        return sample(df, rows, row_id, seed)
    (common, _), (rare, n) = counts
    few = min(n, rows // 2)
    return capped(df, target, {rare: few, common: rows - few}, row_id, seed)


def truncated_series(df: DataFrame, ids: Sequence[str], date: str, rows: int, seed: int = SEED) -> DataFrame:
    """Series cut to their last part, the longest of a list of lengths with at most ``rows`` rows; if the shortest has more, ``sample_series`` of it.

    Which list depends on the most frequent gap of dates. Without gaps the table stays whole.
    """
    unit = time_unit(df, ids, date)
    if unit is None:
        return df
    for length in HIGH_FREQUENCY if unit < FREQUENT else LOW_FREQUENCY:
        part = recent(df, ids, date, length)
        if part.count() <= rows:
            return part
    return sample_series(part, ids, date, rows, seed)


def strategy_caps(counts: Sequence[tuple[object, int]], strategy: object = "auto") -> dict[object, int]:
    """The caps of an under-sampling strategy.

    A name (auto, majority, not minority, not majority, all), a mapping of
    classes to counts, a list of classes to cut to the rarest's count, or, for
    two classes, the ratio of minority to majority. Without classes there are no caps.
    """
    sizes = dict(counts)
    if not sizes:
        return {}
    least, most = min(sizes.values()), max(sizes.values())
    minority = min(sizes, key=lambda v: sizes[v])
    majority = max(sizes, key=lambda v: sizes[v])
    if isinstance(strategy, Mapping):
        unknown = set(strategy) - set(sizes)
        if unknown:
            raise ValueError(f"Unknown classes: {sorted(map(str, unknown))}")
        for v, n in strategy.items():
            if n > sizes[v]:
                raise ValueError(f"Class {v} has {sizes[v]} rows, fewer than {n}")
        return dict(strategy)
    if isinstance(strategy, float):
        if len(sizes) != 2 or not 0 < strategy <= 1:
            raise ValueError("A ratio from 0 to 1 needs two classes")
        if (cut := int(least / strategy)) > most:
            raise ValueError("The ratio would need more majority rows than there are")
        return {majority: cut}
    chosen = {
        "auto": set(sizes) - {minority}, "not minority": set(sizes) - {minority}, "majority": {majority}, "not majority": set(sizes) - {majority}, "all": set(sizes),
    }.get(strategy) if isinstance(strategy, str) else set(strategy)
    if chosen is None:
        raise ValueError(f"Unknown strategy: {strategy}")
    return {v: least for v in sizes if v in chosen}


def under_sample(df: DataFrame, target: str, row_id: str, strategy: object = "auto", seed: int = SEED) -> DataFrame:
    return capped(df, target, strategy_caps(class_counts(df, target), strategy), row_id, seed)


# Time series


def time_unit(df: DataFrame, ids: Sequence[str], date: str) -> int | None:
    """The most frequent gap in seconds between distinct dates of an id, the least of equally frequent ones."""
    dates = df.filter(F.col(date).isNotNull()).select(*ids, F.unix_micros(F.col(date).cast("timestamp")).alias("_t")).distinct()
    gap = (F.col("_t") - F.lag("_t").over(Window.partitionBy(*(ids or [F.lit(0)])).orderBy("_t"))) / 1_000_000
    got = dates.withColumn("_gap", gap).filter("_gap is not null").groupBy("_gap").count().orderBy(F.desc("count"), "_gap").first()
    return None if got is None else got[0]


def recent(df: DataFrame, ids: Sequence[str], date: str, length: str) -> DataFrame:
    """The rows of each id that are less than ``length`` (an interval such as ``2 years 6 months``) before its last."""
    (last,) = free(df, wanted="_last")
    ends = df.groupBy(*ids).agg(F.max(F.col(date).cast("timestamp")).alias(last))
    if ids:
        keys = {c: f"{last}_{c}" for c in ids}
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
        joined = df.join(ends.withColumnsRenamed(keys), same)
    else:
        joined = df.crossJoin(F.broadcast(ends))  # one row
    words = length.split()
    begin = reduce(lambda t, i: t - F.expr(f"interval {words[i]} {words[i + 1]}"), range(0, len(words), 2), F.col(last))
    return joined.filter(F.col(date).cast("timestamp") > begin).select(*df.columns)


def sample_series(df: DataFrame, ids: Sequence[str], date: str, n: int, seed: int = SEED, least_ids: float = 0.2, recent_first: bool = True) -> DataFrame:
    """Whole series of some ids with at most ``n`` rows together, recent ones first; if these are too few ids, the last dates of some ids."""
    ids = list(ids) or [date]
    per = df.groupBy(*ids).agg(F.max(date).alias("_last"), F.count("*").alias("_n"), F.count_distinct(date).alias("_dates"))
    newest = -F.unix_micros(F.col("_last").cast("timestamp"))
    order = [*([newest] if recent_first else []), -F.col("_n"), F.xxhash64(*ids, F.lit(seed)), *map(F.col, ids)]
    per = cumulated(per, order, {"_sum": F.col("_n")}).withColumn("_sum", F.col("_sum") + F.col("_n"))
    s = per.agg(F.count("*").alias("ids"), F.count(F.when(F.col("_sum") <= n, 1)).alias("fit")).first()
    least = max(int(s.ids * least_ids), 1)
    if s.fit >= least:
        return df.join(per.filter(F.col("_sum") <= n).select(*ids), ids, "left_semi")
    some = df.join(per.orderBy(F.desc("_dates"), *ids).limit(least if s.fit else s.ids).select(*ids), ids, "left_semi")
    dates = some.groupBy(date).agg(F.count("*").alias("_n"))
    dates = cumulated(dates, [-F.unix_micros(F.col(date).cast("timestamp"))], {"_sum": F.col("_n")}).withColumn("_sum", F.col("_sum") + F.col("_n"))
    return some.join(dates.filter(F.col("_sum") <= n).select(date), date, "left_semi")


# Folds


def k_folds(df: DataFrame, row_id: str, k: int = 5, seed: int = SEED, groups: Sequence[str] | None = None, name: str = "fold") -> DataFrame:
    """A fold for each row by a hash; rows of a group share it."""
    by = [F.col(g) for g in groups] if groups else [F.col(row_id)]
    return df.withColumn(name, F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, target: str, order: Column, k: int = 5, name: str = "fold") -> DataFrame:
    """Folds that have equal shares of each class, to a row: the rows of a class are dealt in turn, in ``order``."""
    classes = [v for v, _ in class_counts(df, target)]
    (o, *counts) = free(df, wanted="_order " + " ".join(f"_class{i}" for i in range(len(classes))))
    own = {c: (F.col(target) == F.lit(v)).cast("long") for c, v in zip(counts, classes)}
    out = cumulated(df.withColumn(o, order), [F.col(o)], own)
    place = reduce(lambda acc, cv: F.when(F.col(target) == F.lit(cv[1]), F.col(cv[0])).otherwise(acc), zip(counts, classes), F.lit(0))
    kept = [c for c in df.columns if c != name]
    return out.select(*kept, (place % k).cast("int").alias(name))


def shuffle_split(df: DataFrame, groups: Sequence[str], test_size: float = 0.2, seed: int = SEED, name: str = "is_test") -> DataFrame:
    """Whether a row's group is in the test part."""
    share = F.xxhash64(*[F.col(g) for g in groups], F.lit(seed)) / F.lit(float(1 << 64)) + 0.5
    return df.withColumn(name, share < test_size)


def blocked_folds(n: int, k: int = 5, test_size: float = 0.2) -> list[tuple[range, range]]:
    """Rows of training and test of each block of consecutive rows."""
    if k > n:
        raise ValueError(f"{k} splits of {n} rows")
    size = n // k
    if test_size * size <= 1:
        raise ValueError("The test part of a block would have no rows")
    cut = int((1 - test_size) * size)
    return [(range(i * size, i * size + cut), range(i * size + cut, (i + 1) * size)) for i in range(k)]


def blocked_time_series(df: DataFrame, number: str, k: int = 5, test_size: float = 0.2, name: str = "fold") -> DataFrame:
    """``fold`` and ``is_test`` of rows numbered from 0 in time order; rows after the last block have none."""
    n = df.count()
    blocks = blocked_folds(n, k, test_size)
    size, cut = n // k, len(blocks[0][0])
    inside = F.col(number) < size * k
    return df.withColumn(name, F.when(inside, F.floor(F.col(number) / size).cast("int"))).withColumn("is_test", F.when(inside, F.col(number) % size >= cut))


def expanding_folds(n: int, k: int = 5) -> list[tuple[range, range]]:
    """Time-series folds: ever longer training parts, each followed by its test part."""
    size = n // (k + 1)
    first = n - k * size
    return [(range(0, first + i * size), range(first + i * size, first + (i + 1) * size)) for i in range(k)]
