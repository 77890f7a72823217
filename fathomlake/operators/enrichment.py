"""Joining a table with feature sources: exact, by ranges, as of a date, over a second key; hit rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DatetimeType, NumericType

from ..functions.keys import key_combinations
from .names import free
from .ordering import RANGE_ROWS, ranged


def enrich(df: DataFrame, features: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the features of its keys. A column name on both sides is an error.

    Sources are taken to have one row for a key; of more, all join.
    """
    both = (set(df.columns) & set(features.columns)) - set(on)
    if both:
        raise ValueError(f"Columns on both sides: {sorted(both)}")
    return df.join(features, list(on), how)


def join_blocks(blocks: Sequence[DataFrame], on: str) -> DataFrame:
    """Feature blocks side by side, with the keys of all."""
    return reduce(lambda a, b: a.join(b, on, "full"), blocks)


def best_match(df: DataFrame, source: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The source's row for each row of ``df`` by the most specific combination of keys that has one.

    ``matched_by`` names the combination, null without a match. Of several rows
    of the source for a combination, the least by value is taken.
    """
    values = [c for c in source.columns if c not in keys]
    out, (best, m) = df, free(df, source, wanted="_best _m")
    picks: list[Column] = []
    for i, combo in enumerate(key_combinations(keys)):
        hit = source.dropna(subset=list(combo)).groupBy(*combo).agg(F.min(F.struct(*values)).alias(f"{m}{i}"))
        out = out.join(hit, list(combo), "left")
        picks.append(F.when(F.col(f"{m}{i}").isNotNull(), F.struct(F.lit("+".join(combo)).alias("by"), F.col(f"{m}{i}").alias("v"))))
    return out.withColumn(best, F.coalesce(*picks)).select(*df.columns, F.col(best)["by"].alias("matched_by"), *[F.col(best)["v"][v].alias(v) for v in values])


def range_join(df: DataFrame, ranges: DataFrame, key: str, begin: str, end: str, width: int | None = None, how: str = "left") -> DataFrame:
    """``df`` with the ranges that hold its key, both ends included; ``how`` is inner or left.

    With ``width`` keys and ranges meet in buckets of that width, an equi-join:
    choose about the length of a usual range. A range longer than 64 buckets
    is looked up in a coarser level, so no range makes many rows. Without it
    every pair is compared. Null keys and ranges match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"A range join is inner or left, not {how}")
    if width is None:
        return df.join(ranges, (df[key] >= ranges[begin]) & (df[key] <= ranges[end]), how)
    lv, b, n, lv2, b2 = free(df, ranges, wanted="_lv _b _n _lv2 _b2")
    # Levels: the bucket width grows 64-fold; a range goes to the first level at which it spans at most 64 buckets.
    span = (F.col(end) - F.col(begin)).cast("double")
    levels = range(8)
    level = reduce(lambda acc, i: F.when(span <= float(width) * 64.0**i * 63.0, F.lit(i)).otherwise(acc), reversed(levels), F.lit(max(levels)))
    size = lambda of: F.lit(width) * F.pow(F.lit(64.0), F.col(of)).cast("long")
    side = ranges.filter(F.col(begin).isNotNull() & F.col(end).isNotNull() & (F.col(begin) <= F.col(end))).withColumn(lv2, level)
    present = [r[0] for r in side.select(lv2).distinct().collect()] or [0]
    side = side.withColumn(b2, F.explode(F.sequence(F.floor(F.col(begin) / size(lv2)), F.floor(F.col(end) / size(lv2)))))
    inside = (F.col(b) == F.col(b2)) & (F.col(lv) == F.col(lv2)) & (F.col(key) >= F.col(begin)) & (F.col(key) <= F.col(end))
    if len(present) == 1:
        probes = df.withColumn(lv, F.lit(present[0])).withColumn(b, F.floor(F.col(key) / size(lv)))
        return probes.join(side, inside, how).drop(lv, b, lv2, b2)
    probes = df.withColumn(lv, F.explode(F.array(*map(F.lit, present)))).withColumn(b, F.floor(F.col(key) / size(lv)))
    hits = probes.join(side, inside).drop(lv, b, lv2, b2)
    if how == "inner":
        return hits
    # Keys that no level has: from the distinct keys, which meet the buckets once more.
    keys = df.select(F.col(key)).distinct().withColumn(lv, F.explode(F.array(*map(F.lit, present)))).withColumn(b, F.floor(F.col(key) / size(lv)))
    met = keys.join(side.select(lv2, b2, begin, end), inside, "left_semi").select(F.col(key).alias(n)).distinct()
    return hits.unionByName(df.join(met, F.col(key) == F.col(n), "left_anti"), allowMissingColumns=True)


def comparable(*kinds: DataType) -> bool:
    """Whether columns of these types are ordered together: numbers, or all of one type."""
    return all(isinstance(k, NumericType) for k in kinds) or len(set(kinds)) == 1


def first_range(df: DataFrame, ranges: DataFrame, key: str, begin: str, end: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the other columns of the first range, by its begin, end and these, that holds its key, both ends included.

    Null keys and ranges match nothing; without a match the columns are null. No pairs are formed, however much ranges
    overlap: a range is the first one only for keys above the ends of all ranges before it. Ranges that end below
    that never are; of the rest, each key belongs to the one with the next end, which may still begin above it.
    """
    values = [c for c in ranges.columns if c not in (begin, end)]
    lo, hi, v, top, at, k, piece, upcoming, r = free(df, ranges, wanted="_lo _hi _v _top _at _k _piece _upcoming _range")
    past = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)

    def parted(d: DataFrame, by: str) -> tuple[DataFrame, bool]:
        many = isinstance(d.schema[by].dataType, (NumericType, DatetimeType)) and d.count() > rows
        return (ranged(d, F.col(by), r, rows) if many else d.withColumn(r, F.lit(0))), many

    known = ranges.filter(F.col(begin) <= F.col(end)).groupBy(F.col(begin).alias(lo), F.col(end).alias(hi)).agg(F.min(F.struct(*values)).alias(v))
    parts, many = parted(known, lo)
    pieces = parts.withColumn(top, F.max(hi).over(past(Window.partitionBy(r).orderBy(lo, hi))))
    if many:
        tops = parts.groupBy(r).agg(F.max(hi).alias(upcoming)).withColumn(upcoming, F.max(upcoming).over(past(Window.orderBy(r))))  # a row for each range of begins
        pieces = pieces.join(F.broadcast(tops), r).withColumn(top, F.greatest(top, upcoming))
    pieces = pieces.filter(F.col(top).isNull() | (F.col(hi) > F.col(top))).select(F.col(hi).alias(at), F.struct(lo, v).alias(piece))
    probes = df.filter(F.col(key).isNotNull()).select(F.col(key).alias(k)).distinct()
    both, many = parted(pieces.unionByName(probes.select(F.col(k).alias(at), k), allowMissingColumns=True), at)
    # Backwards, so that the last piece seen has the next end; a piece comes before a key at its end.
    back = Window.partitionBy(r).orderBy(F.col(at).desc(), F.col(k).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(piece, F.last(piece, ignorenulls=True).over(back)).filter(F.col(k).isNotNull())
    if many:
        least = F.min_by(piece, F.when(F.col(piece).isNotNull(), F.col(at)))
        ends = both.groupBy(r).agg(least.alias(upcoming)).withColumn(upcoming, F.last(upcoming, ignorenulls=True).over(past(Window.orderBy(F.col(r).desc()))))
        found = found.join(F.broadcast(ends), r).withColumn(piece, F.coalesce(piece, upcoming))
    found = found.filter(F.col(piece)[lo] <= F.col(k)).select(k, piece)
    return df.join(found, F.col(key) == F.col(k), "left").select(*df.columns, *[F.col(piece)[v][c].alias(c) for c in values])


def _last_before(df: DataFrame, source: DataFrame, on: Sequence[str], at: str, snapshot: str, found: str, forward: bool, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``found``, (time, row) of the source's last snapshot of its keys up to the time ``at``, or the first from then on.

    Both tables are sorted once, by keys and range of time; what is known at the start of a range is carried
    over from earlier ones of the keys. So no pairs are formed, and keys of very many rows have many tasks.
    """
    t, side, r, now, last = free(df, source, wanted="_t _side _range _now _last")
    sign = -1 if forward else 1
    keys = {c: f"{r}_{c}" for c in on}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * sign
    known = F.struct(micros(snapshot).alias("t"), F.struct(*source.columns).alias("row"))
    a = df.select(*[F.col(c).alias(k) for c, k in keys.items()], micros(at).alias(t), F.lit(1).alias(side), F.struct(*df.columns).alias(now), F.lit(None).cast(source.select(known).schema[0].dataType).alias(found))
    b = source.select(*[F.col(c).alias(k) for c, k in keys.items()], micros(snapshot).alias(t), F.lit(0).alias(side), F.lit(None).cast(a.schema[now].dataType).alias(now), known.alias(found))
    both = a.unionByName(b.filter(F.col(t).isNotNull()))
    many = both.count() > rows
    both = ranged(both, F.col(t), r, rows) if many else both.withColumn(r, F.lit(0))
    # Of equal times the least row comes last, and so counts.
    w = Window.partitionBy(*keys.values(), r).orderBy(t, side, F.col(found).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(found, F.last(found, ignorenulls=True).over(w)).filter(F.col(side) == 1)
    if many:
        best = F.min(F.when(F.col(side) == 0, F.struct((-F.col(t)).alias("t"), F.col(found)["row"].alias("row"))))
        ends = both.groupBy(*keys.values(), r).agg(best.alias(last))
        before = Window.partitionBy(*keys.values()).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        ends = ends.withColumn(last, F.last(last, ignorenulls=True).over(before)).filter(F.col(last).isNotNull())
        carried = F.when(F.col(last).isNotNull(), F.struct((-F.col(last)["t"]).alias("t"), F.col(last)["row"].alias("row")))
        out = out.join(ends, [*keys.values(), r], "left").withColumn(found, F.coalesce(found, carried))
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys.values()], F.col(t).isNotNull())
    return out.select(F.col(f"{now}.*"), F.when(whole & F.col(found).isNotNull(), F.struct((F.col(found)["t"] * sign).alias("t"), F.col(found)["row"].alias("row"))).alias(found))


def as_of_join(df: DataFrame, source: DataFrame, on: Sequence[str], date: str, snapshot: str, row_id: str, limit_days: int | None = None, direction: str = "backward", rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the source's nearest snapshot of the same keys: the last up to the date, the first from it, or the nearest.

    Within ``limit_days`` if given; without a match, or with a null key or date, the source's columns are
    null. Of equally near snapshots the earlier one counts, of equal ones the least. ``row_id`` is not needed any more.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"{direction} is no direction: backward, forward, nearest")
    past, later = free(df, source, wanted="_past _later")
    values = [c for c in source.columns if c not in on]
    out, at = df, F.unix_micros(F.col(date).cast("timestamp"))
    if direction != "forward":
        out = _last_before(out, source, on, date, snapshot, past, False, rows)
    if direction != "backward":
        out = _last_before(out, source, on, date, snapshot, later, True, rows)
    gap = lambda c: F.abs(at - F.col(c)["t"])
    if direction == "nearest":
        best = F.when(F.col(past).isNull() | (gap(later) < gap(past)), F.col(later)).otherwise(F.col(past))
    else:
        best = F.col(past if direction == "backward" else later)
    if limit_days is not None:
        best = F.when(F.abs(at - best["t"]) <= limit_days * 86_400_000_000, best)
    return out.withColumn(past, best).select(*df.columns, *[F.col(past)["row"][v].alias(v) for v in values])


def as_of_by_window(df: DataFrame, source: DataFrame, on: Sequence[str], date: str, snapshot: str, row_id: str) -> DataFrame:
    """The backward as-of join."""
    return as_of_join(df, source, on, date, snapshot, row_id)


def two_hop_join(df: DataFrame, bridge: DataFrame, source: DataFrame, key: str, second: str) -> DataFrame:
    """``df`` with the features of the second key that ``bridge`` has for its key."""
    return df.join(bridge.select(key, second).distinct(), key, "left").join(source, second, "left")


def leaked(train: DataFrame, evaluation: DataFrame) -> bool:
    """Whether a row of the evaluation set, by all common columns, is in the training set (null equals null)."""
    common = [c for c in train.columns if c in evaluation.columns]
    return bool(train.select(*common).intersect(evaluation.select(*common)).take(1))


def without(df: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*on).distinct(), list(on), "left_anti")


def hit_rates(df: DataFrame, matched: str, keys: Mapping[str, str]) -> DataFrame:
    """``(key, rows, matched, hit_rate)``: the share of matched rows, over all and over the rows that have each key."""
    hit = F.col(matched).cast("double")
    first = df.select(F.lit("all").alias("key"), hit.alias("m"))
    rest = [df.filter(F.col(c).isNotNull()).select(F.lit(kind).alias("key"), hit.alias("m")) for c, kind in keys.items()]
    both = reduce(lambda a, b: a.unionByName(b), [first, *rest])
    return both.groupBy("key").agg(F.count("*").alias("rows"), F.sum("m").cast("long").alias("matched"), F.avg("m").alias("hit_rate"))


def beside(tables: Sequence[DataFrame], row_id: str) -> DataFrame:
    """Tables side by side by their row id, with the rows of all; a column name that two of them have is an error."""
    names = [c for t in tables for c in t.columns if c != row_id]
    if len(set(names)) < len(names):
        raise ValueError(f"Columns in several tables: {sorted({c for c in names if names.count(c) > 1})}")
    return join_blocks(tables, row_id)
