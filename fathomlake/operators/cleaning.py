"""Cleaning a table: normal forms of columns, one-hot groups, uninformative columns, duplicates, record ids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, FloatType, IntegralType, NumericType, StringType

from ..functions import keys as k
from .names import free
from .ordering import numbered

#: Characters of a text that are kept.
LONGEST = 24_573
#: One-hot columns by their prefix.
Groups = dict[str, list[str]]


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# Columns


def normal_names(columns: Sequence[str]) -> dict[str, str]:
    """Old names to new ones: lower case letters, digits and underscores, and six digits of a hash of the old name."""
    out: dict[str, str] = {}
    for c in columns:
        plain = re.sub(r"[^a-z0-9_]", "_", c.lower())
        plain = plain if re.match(r"[a-z]", plain) else "a" + plain
        name = f"{plain}_{hashlib.sha256(c.encode()).hexdigest()[:6]}"
        while name in out.values():
            name += "_"
        out[c] = name
    return out


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.select(*[_q(c).alias(mapping.get(c, c)) for c in df.columns])


def normalize(df: DataFrame, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Columns in their normal forms; ``kinds`` says which are search keys.

    Long texts are cut, booleans become ``True`` and ``False``, 32-bit floats 64-bit, numbers
    with decimal commas doubles; keys by kind: phone, email (hash), postal_code, country, date.
    Null stays null.
    """
    kinds = kinds or {}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in kinds]
    comma = {c for c in texts if _has_decimal_comma(df, c)} if texts else set()
    out = []
    for f in df.schema.fields:
        c, kind = _q(f.name), kinds.get(f.name)
        if kind == "phone":
            c = k.phone(c)
        elif kind == "email":
            c = k.email_hash(c)
        elif kind == "postal_code":
            c = k.postal_code(c)
        elif kind == "country":
            c = k.country(c)
        elif kind in ("date", "datetime"):
            c = k.date_key(k.parse_dates(df, f.name))
        elif isinstance(f.dataType, BooleanType):
            c = F.initcap(c.cast("string"))
        elif isinstance(f.dataType, FloatType):
            c = c.cast("double")
        elif f.name in comma:
            c = F.regexp_replace(c, ",", ".").try_cast("double")
        elif isinstance(f.dataType, StringType):
            c = F.substring(c, 1, LONGEST)
        out.append(c.alias(f.name))
    return df.select(*out)


def _has_decimal_comma(df: DataFrame, name: str) -> bool:
    head = [r[0] for r in df.select(_q(name)).limit(10).collect() if r[0] is not None]
    return any(re.fullmatch(r"[0-9]+,[0-9]*", v) for v in head)


def constant_columns(df: DataFrame) -> list[str]:
    """Columns of one value (null is one), or whose most frequent value has 99 % of the rows, unless they have two values or are integers."""
    distinct = df.agg(*[(F.count_distinct(_q(c)) + F.max(_q(c).isNull().cast("int"))).alias(f"c{i}") for i, c in enumerate(df.columns)], F.count("*").alias("n")).first()
    out = []
    for i, f in enumerate(df.schema.fields):
        if (distinct[f"c{i}"] or 0) <= 1:
            out.append(f.name)
        elif distinct[f"c{i}"] != 2 and not isinstance(f.dataType, IntegralType) and not whole_numbers(df, f.name):
            top = df.groupBy(_q(f.name)).count().agg(F.max("count")).first()[0]
            if top >= 0.99 * distinct["n"]:
                out.append(f.name)
    return out


def whole_numbers(df: DataFrame, name: str) -> bool:
    """Whether a numeric column holds whole numbers only."""
    if not isinstance(df.schema[name].dataType, NumericType):
        return False
    return bool(df.agg(F.bool_and(_q(name) == F.floor(_q(name)))).first()[0])


def high_cardinality_columns(df: DataFrame, share: float = 0.85, least_rows: int = 100, approximate: bool = False) -> list[str]:
    """Text and whole-number columns with as many values, null included, as ``share`` of the rows."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, IntegralType)) or whole_numbers(df, f.name)]
    count = F.approx_count_distinct if approximate else F.count_distinct
    got = df.agg(F.count("*").alias("n"), *[(count(_q(c)) + F.max(_q(c).isNull().cast("int"))).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if got["n"] >= least_rows and got[f"c{i}"] >= share * got["n"]]


# One-hot groups


def one_hot_groups(df: DataFrame, least_share: float = 0.6) -> Groups:
    """Columns of each prefix with consecutive numeric suffixes whose values are 0 and 1, mostly 0, with a 1 in most rows."""
    by_prefix: dict[str, list[tuple[int, str]]] = {}
    for f in df.schema.fields:
        m = re.fullmatch(r"(.*?\D)(\d+)", f.name)
        if m and isinstance(f.dataType, NumericType):
            by_prefix.setdefault(m[1], []).append((int(m[2]), f.name))
    out = {}
    for prefix, members in by_prefix.items():
        members.sort()
        numbers = [n for n, _ in members]
        if len(members) < 2 or numbers != list(range(numbers[0], numbers[0] + len(members))):
            continue
        cols = [_q(c) for _, c in members]
        got = df.agg(
            *[F.bool_and(c.isin(0, 1)).alias(f"b{i}") for i, c in enumerate(cols)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
            F.avg((F.greatest(*cols) > 0).cast("double")).alias("hot"),
        ).first()
        if all(got[f"b{i}"] for i in range(len(cols))) and all(got[f"m{i}"] <= 0.5 for i in range(len(cols))) and (got["hot"] or 0) >= least_share:
            out[prefix] = [c for _, c in members]
    return out


def decode_one_hot(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each group as one text column named by its prefix: the suffix of the column that is 1.

    None is null. If several are 1, their suffixes are joined by commas. Pass the
    groups found at fit to decode other tables alike.
    """
    gone = {c for cs in groups.values() for c in cs}
    new = []
    for prefix, columns in groups.items():
        hot = F.filter(F.array(*[F.when(_q(c) == 1, F.lit(c[len(prefix) :])) for c in columns]), lambda x: x.isNotNull())
        new.append(F.when(F.size(hot) > 0, F.array_join(hot, ",")).alias(prefix))
    return df.select(*[_q(c) for c in df.columns if c not in gone], *new)


# Rows


def valid_rows(df: DataFrame, keys: Sequence[str], mandatory: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """Rows with a finite target, some key, and all mandatory keys."""
    ok: list[Column] = [reduce(lambda a, b: a | b, [_q(c).isNotNull() for c in keys])] if keys else []
    ok += [_q(c).isNotNull() for c in mandatory]
    if target is not None:
        t = _q(target)
        ok.append(t.isNotNull())
        if isinstance(df.schema[target].dataType, NumericType):
            ok.append(~F.isnan(t.cast("double")) & (F.abs(t.cast("double")) != float("inf")))
        else:
            ok.append(t.cast("string") != "")
    return df.filter(reduce(lambda a, b: a & b, ok)) if ok else df


def first_of_equal(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row, in ``order``, of each combination of values (null equals null)."""
    (place,) = free(df, wanted="_place")
    w = Window.partitionBy(*[_q(c) for c in columns]).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place)


def without_repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose combination of values occurs once only."""
    (times,) = free(df, wanted="_times")
    w = Window.partitionBy(*[_q(c) for c in columns])
    return df.withColumn(times, F.count("*").over(w)).filter(F.col(times) == 1).drop(times)


_IDS = ("system_record_id", "entity_system_record_id", "sort_id", "eval_set_index")


def drop_full_duplicates(df: DataFrame, row_id: str, target: str | None = "target", segment: str | None = None) -> DataFrame:
    """One of each group of equal rows, then none of rows that differ in the target alone.

    Ids, the order ``row_id`` and the segment do not make rows different; the
    training segment (0) comes first. Evaluation segments without any target
    take no part in the second step, but their copies of remaining rows go.
    """
    apart = {*_IDS, row_id, segment}
    columns = [c for c in df.columns if c not in apart]
    order = ([_q(segment)] if segment else []) + [_q(row_id)]
    out = first_of_equal(df, columns, order)
    if target is None or target not in df.columns:
        return out
    values = [c for c in columns if c != target]
    if segment is None:
        return without_repeated(out, values)
    labelled, times, seg = free(out, wanted="_labelled _times _segment")
    # A row for each segment, of which there are few.
    with_target = out.groupBy(_q(segment).alias(seg)).agg(F.max(_q(target).isNotNull()).alias(labelled))
    out = out.join(F.broadcast(with_target), _q(segment).eqNullSafe(F.col(seg))).drop(seg).withColumn(labelled, (_q(segment) == 0) | F.col(labelled))
    w = Window.partitionBy(*[_q(c) for c in values])
    out = out.withColumn(times, F.sum(F.col(labelled).cast("int")).over(w))
    out = out.filter(~F.col(labelled) | (F.col(times) == 1)).drop(times)
    return first_of_equal(out, values, [F.col(labelled).desc(), *order]).drop(labelled)


def drop_contradictions(df: DataFrame, persons: Sequence[str], date: str, target: str, segment: str | None = None, days: int = 60) -> DataFrame:
    """Drop all rows of persons whose target changes within ``days``, by segment.

    A segment in which 60 % of the persons have several dates, or without any
    target, stays as it is. ``date`` is a timestamp or milliseconds.
    """
    seg = [_q(segment)] if segment else []
    who = [*seg, *[_q(p) for p in persons]]
    at = F.unix_millis(_q(date).cast("timestamp")) if not isinstance(df.schema[date].dataType, NumericType) else _q(date)
    known = df.filter(reduce(lambda a, b: a & b, [_q(p).isNotNull() for p in persons])).withColumn("_at", at)
    w = Window.partitionBy(*who).orderBy("_at", _q(target))
    step = known.withColumn("_changed", ~F.lag(_q(target)).over(w).eqNullSafe(_q(target)) & (F.col("_at") - F.lag("_at").over(w) < days * 86_400_000))
    people = step.groupBy(*who).agg(F.count_distinct("_at").alias("_dates"), F.count_distinct(_q(target)).alias("_targets"), F.max("_changed").alias("_bad"))
    if segment:
        share = people.groupBy(_q(segment)).agg(F.avg((F.col("_dates") > 1).cast("double")).alias("_several"))
        people = people.join(share, segment)
    else:
        people = people.crossJoin(F.broadcast(people.agg(F.avg((F.col("_dates") > 1).cast("double")).alias("_several"))))
    bad = people.filter("_bad and _targets > 1 and _several < 0.6").select(*([segment] if segment else []), *persons)
    return df.join(bad, [*([segment] if segment else []), *persons], "left_anti")


def record_ids(df: DataFrame, keys: Sequence[str], date: str | None = None, segment: str | None = None, row_id: str = "row_id", name: str = "system_record_id") -> DataFrame:
    """Numbers by (segment, date, hash of the keys): the training segment first. The rows' order does not matter.

    Segments, of which there are few, are numbered one after the other, so that ranges are of dates or hashes.
    """
    columns = [_q(c) for c in keys if c != date]
    order = [*([_q(date)] if date else []), *([F.xxhash64(*columns)] if columns else []), _q(row_id)]
    if segment is None:
        return numbered(df, order, name)
    sizes = df.groupBy(_q(segment).alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()
    out, start = None, 0
    for s in sizes:
        part = numbered(df.filter(_q(segment).eqNullSafe(F.lit(s.s))), order, name)
        part = part.withColumn(name, F.col(name) + start)
        out, start = part if out is None else out.unionByName(part), start + s.n
    return numbered(df, order, name) if out is None else out


def hash_ids(df: DataFrame, columns: Sequence[str], name: str = "entity_system_record_id") -> DataFrame:
    """A 64-bit hash of the columns, taken in the order of their names."""
    return df.withColumn(name, F.xxhash64(*[_q(c) for c in sorted(columns)]))


def digest(df: DataFrame) -> str:
    """A hash of the table's rows as a multiset."""
    h = F.xxhash64(*[_q(c) for c in sorted(df.columns)])
    got = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(repr((sorted(df.columns), *got)).encode()).hexdigest()


def melt_keys(df: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row for each combination of one column of every kind; a column named by the kind holds the value.

    Kinds with one column are just renamed. Nulls stay.
    """
    for kind, columns in kinds.items():
        if len(columns) == 1:
            df = rename(df, {columns[0]: kind})
        elif columns:
            rest = [c for c in df.columns if c not in columns]
            df = df.unpivot([_q(c) for c in rest], [_q(c) for c in columns], f"{kind}_column", kind).drop(f"{kind}_column")
    return df


def dummies(df: DataFrame, column: str, values: Sequence[object] | None = None, most: int = 100) -> DataFrame:
    """``column`` as a column of 0 and 1 for each value, ``<column>_<value>``; null is 0 in all.

    Pass the values of one table to treat others alike; found ones are sorted, and more than ``most`` are an error.
    """
    if values is None:
        values = [r[0] for r in df.filter(_q(column).isNotNull()).select(_q(column)).distinct().orderBy(_q(column)).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} values")
    flags = [F.coalesce((_q(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]
    return df.select(*[_q(c) for c in df.columns if c != column], *flags)
