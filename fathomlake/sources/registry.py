"""Feature sources by name, and an enricher that fits and applies them.

A source is any table with search keys. It stands in for a remote search: what
matches, how often, and with which features, is computed here by joins.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as keyfn
from ..functions.keys import detect, needs_current_date, validate_keys
from ..operators import cleaning, enrichment, evaluation, sampling, stability, targets
from ..operators.names import free
from ..plans.compiler import features as compute

#: What a source must have: rows, and the share of rows with a key.
LEAST_ROWS, LEAST_FILLED = 1000, 0.5
DATES = ("date", "datetime")


@dataclass
class Source:
    """A table of features, one row for a key (and snapshot).

    ``keys`` maps columns to kinds. ``snapshot`` is a date column: rows of it are
    joined as of the date of the enriched row, within ``limit_days``. ``ranges`` maps a kind of key to the
    columns in which its range begins and ends, ``range_width`` is the usual length of a range. ``formulas`` are computed over the joined row.
    """

    name: str
    table: DataFrame
    keys: dict[str, str]
    snapshot: str | None = None
    limit_days: int | None = None
    ranges: dict[str, tuple[str, str]] = field(default_factory=dict)
    formulas: dict[str, str] = field(default_factory=dict)
    range_width: int | None = None

    def features(self) -> list[str]:
        apart = {*self.keys, self.snapshot, *(c for pair in self.ranges.values() for c in pair)}
        return [c for c in self.table.columns if c not in apart]


class Registry:
    def __init__(self) -> None:
        self.sources: dict[str, Source] = {}

    def register(self, source: Source, least_rows: int = LEAST_ROWS) -> Source:
        """Add a source, checked: enough rows, keys filled in half of them, keys that go together."""
        if not source.keys and not source.ranges:
            raise ValueError("A source needs keys")
        validate_keys(source.keys)
        names = list(source.keys)
        got = source.table.agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"f{i}") for i, c in enumerate(names)]).first()
        if got.n < least_rows:
            raise ValueError(f"{source.name} has {got.n} rows; a source needs {least_rows}")
        empty = [c for i, c in enumerate(names) if (got[f"f{i}"] or 0) < LEAST_FILLED]
        if empty:
            raise ValueError(f"Keys of {source.name} are mostly empty: {empty}")
        self.sources[source.name] = source
        return source

    def register_table(self, name: str, path_or_table: str, spark, keys: dict[str, str], least_rows: int = LEAST_ROWS, **options) -> Source:
        """Add a Parquet folder, or a table of the catalogue, as a source."""
        table = spark.read.parquet(path_or_table) if "/" in path_or_table else spark.table(path_or_table)
        return self.register(Source(name, table, keys, **options), least_rows)


def normal_key(df: DataFrame, name: str, kind: str) -> Column:
    """A key column in the form in which keys of its kind are compared. An address and its hash are alike."""
    c = F.col(name)
    forms = {"phone": keyfn.phone, "email": keyfn.email_hash, "hem": lambda c: F.lower(F.trim(c)), "postal_code": keyfn.postal_code, "country": keyfn.country, "ip": lambda c: keyfn.ip(c.cast("string"))["binary"]}
    return forms[kind](c) if kind in forms else c


def _compared(kind: str) -> str:
    return "hem" if kind == "email" else kind


class Enricher:
    """Adds the features of registered sources to tables by their search keys.

    ``keys`` maps columns to kinds; kinds that it lacks are detected. Keys are compared in their normal forms; the
    columns stay as they are. Several columns of one kind are looked up in turn, the first that matches counts.
    ``country`` is the country of all rows if no column has it; ``today`` stands for the date where no key has time.
    ``fit`` learns keys, one-hot groups, dropped columns, hit rates and stable features; ``transform`` applies them.
    """

    def __init__(self, registry: Registry, keys: dict[str, str] | None = None, detect_keys: bool = True, country: str | None = None, today: datetime.date | None = None, on_progress: Callable[[str, int], None] | None = None, search_id: str | None = None) -> None:
        self.registry, self.keys, self.detect_keys = registry, dict(keys or {}), detect_keys
        self.country, self.today, self.on_progress = country, today, on_progress
        self.search_id = search_id
        self.dropped: list[str] = []
        self.one_hot: dict[str, list[str]] = {}
        self.hit_rates: dict[str, DataFrame] = {}
        self.warnings: list[str] = []
        self.unstable: list[str] = []
        self.task: str | None = None
        self.selected: list[str] | None = None

    def _tell(self, stage: str, percent: int) -> None:
        if self.on_progress:
            self.on_progress(stage, percent)

    def fit(
        self, df: DataFrame, target: str, row_id: str = "row_id", segment: str | None = None, evaluations: Sequence[DataFrame] = (),
        params: stability.Stability | None = None, on_search_id: Callable[[str], None] | None = None,
    ) -> Enricher:
        """Learn from the training rows; ``evaluations`` are further tables like it.

        An evaluation table without any target is out of time: it takes part in the stability of features if
        there is a date among the keys, and is only named in ``warnings`` otherwise. ``params`` switches on
        the choice of features that are stable over time.
        """
        self._tell("start", 0)
        if self.detect_keys:
            plain = df.drop(target, row_id, *([segment] if segment else []))
            self.keys |= {c: kind for c, kind in detect(plain, list(self.keys)).items() if kind not in self.keys.values()}
        kinds = dict(self.keys) | ({"country": "country"} if self.country and "country" not in self.keys.values() else {})
        validate_keys(kinds)
        if on_search_id and self.search_id:
            on_search_id(self.search_id)
        df = targets.numeric_target(df, target)
        self.task = targets.task_type(df, target, any(k in DATES for k in self.keys.values()))
        parts = segment or free(df, wanted="_segment")[0]
        both = df if segment else df.withColumn(parts, F.lit(0))
        has_date = any(k in DATES for k in self.keys.values())
        for i, e in enumerate(evaluations, 1):
            known = bool(e.filter(F.col(target).isNotNull()).take(1))
            if not known and not has_date:
                self.warnings.append(f"Evaluation set {i} has no target and the keys no date: it is not used for stability")
            both = both.unionByName(e.withColumn(target, F.col(target).cast(both.schema[target].dataType)).withColumn(parts, F.lit(i)), allowMissingColumns=True)
        self._tell("keys", 20)
        labelled = cleaning.valid_rows(both, list(self.keys), target=target).unionByName(cleaning.valid_rows(both.filter((F.col(parts) > 0) & F.col(target).isNull()), list(self.keys)))
        rows = cleaning.drop_full_duplicates(labelled, row_id, target, parts if segment or evaluations else None)
        if not (segment or evaluations):
            rows = rows.drop(parts)
        train = rows if not (segment or evaluations) else rows.filter(F.col(parts) == 0)
        if self.task != targets.REGRESSION and targets.is_imbalanced(train, target, self.task):
            self.warnings.append("The target is imbalanced: frequent classes are cut for training")
        client = [c for c in df.columns if c not in {target, row_id, segment, *self.keys}]
        if client:
            self.one_hot = cleaning.one_hot_groups(train.select(*client))
            self.dropped = cleaning.constant_columns(train.select(*client))
            self.dropped += [c for c in cleaning.high_cardinality_columns(train.select(*client)) if c not in self.dropped]
        self._tell("sources", 50)
        for source in self.registry.sources.values():
            joined = self._join(train.drop(*self._repeated(train)), source, row_id).withColumn("_hit", F.coalesce(F.col("_hit"), F.lit(False)))
            self.hit_rates[source.name] = enrichment.hit_rates(joined, "_hit", {c: k for c, k in self.keys.items() if c in joined.columns})
        date = next((c for c, k in self.keys.items() if k in DATES), None)
        if params is not None and date is not None:
            out = self.transform(rows, row_id)
            new = [c for c in out.columns if c not in rows.columns]
            texts = [c for c in new if not isinstance(out.schema[c].dataType, targets.NumericType)]
            self.unstable = stability.unstable(out.withColumn(date, keyfn.parse_dates(out, date)), new, date, texts, params)
            self.selected = [c for c in new if c not in self.unstable]
        self._tell("done", 100)
        return self

    def fit_transform(self, df: DataFrame, target: str, row_id: str = "row_id", **options) -> DataFrame:
        return self.fit(df, target, row_id, **options).transform(df, row_id)

    def _repeated(self, df: DataFrame) -> set[str]:
        return {c for s in self.registry.sources.values() for c in s.features() if c in df.columns}

    def transform(self, df: DataFrame, row_id: str = "row_id", keep_input: bool = True) -> DataFrame:
        """The rows of ``df`` in any order, one for each, with columns of the input, then those of each source.

        ``row_id`` must tell rows apart. With ``keep_input`` false the input's columns are its ids and keys only.
        """
        out = df.drop(*self.dropped, *self._repeated(df))
        groups = {p: cs for p, cs in self.one_hot.items() if all(c in out.columns for c in cs)}
        if groups:
            out = cleaning.decode_one_hot(out, groups)
        mine = set(out.columns)
        for source in self.registry.sources.values():
            out = self._join(out, source, row_id).drop("_hit")
            if source.formulas:
                out = compute(out, source.formulas, row_id=row_id)
        if not keep_input:
            out = out.select(*[c for c in out.columns if c not in mine or c == row_id or c in self.keys])
        return out if self.selected is None else out.select(*[c for c in out.columns if c in mine or c in self.selected])

    def _join(self, df: DataFrame, source: Source, row_id: str) -> DataFrame:
        """``df`` with the source's features and ``_hit``, a row for a row."""
        mine: dict[str, list[str]] = {}
        for c, kind in self.keys.items():
            if c in df.columns:
                mine.setdefault(_compared(kind), []).append(c)
        values, hit = source.features(), "_hit"
        (k,) = free(df, source.table, wanted="_key")
        kind_of = {c: self.keys[c] for cs in mine.values() for c in cs}
        table = source.table.withColumn(hit, F.lit(True))
        rows = df
        if self.country and "country" not in mine:
            rows, mine["country"] = rows.withColumn(f"{k}_country", F.lit(self.country)), [f"{k}_country"]
            kind_of[f"{k}_country"] = "country"
        extra = [c for c in rows.columns if c not in df.columns]
        date = next((mine[d][0] for d in DATES if d in mine), None)
        if date is None and source.snapshot and needs_current_date(self.keys):
            date = f"{k}_today"
            rows, extra = rows.withColumn(date, F.lit(self.today or datetime.date.today())), [*extra, date]
        for kind, (begin, end) in source.ranges.items():
            if kind in mine:
                if enrichment.comparable(rows.schema[mine[kind][0]].dataType, table.schema[begin].dataType, table.schema[end].dataType):
                    return enrichment.first_range(rows, table.select(begin, end, *values, hit), mine[kind][0], begin, end).select(*df.columns, *values, hit)
                met = enrichment.range_join(rows.select(row_id, mine[kind][0]), table, mine[kind][0], begin, end, source.range_width, "inner")
                one = met.groupBy(row_id).agg(F.min(F.struct(begin, end, *values, hit)).alias(k))
                return df.join(one, row_id, "left").select(*df.columns, *[F.col(k)[v].alias(v) for v in [*values, hit]])
        on = {c: _compared(kind) for c, kind in source.keys.items() if _compared(kind) in mine and kind not in DATES}
        if not on:
            return df.withColumns({f: F.lit(None).cast(source.table.schema[f].dataType) for f in values}).withColumn(hit, F.lit(False))
        keyed = table.select(*[normal_key(table, c, source.keys[c]).alias(f"{k}{i}") for i, c in enumerate(on)], *values, *([source.snapshot] if source.snapshot else []), hit)
        keyed = keyed.dropna(subset=[f"{k}{i}" for i in range(len(on))])
        names = [f"{k}{i}" for i in range(len(on))]
        as_of = source.snapshot and date
        if not as_of:
            keyed = keyed.groupBy(*names).agg(F.min(F.struct(*values, hit)).alias(k)).select(*names, *[F.col(k)[v].alias(v) for v in [*values, hit]])
        rows = rows.withColumns({n: F.array(*[normal_key(rows, c, kind_of[c]) for c in mine[kind]]) for n, kind in zip(names, on.values())})
        several = [n for n, kind in zip(names, on.values()) if len(mine[kind]) > 1]

        def look_up(probes: DataFrame) -> DataFrame:
            if not as_of:
                return enrichment.enrich(probes, keyed, names)
            dated = probes.withColumn(date, keyfn.parse_dates(probes, date))
            return enrichment.as_of_join(dated, keyed, names, date, source.snapshot, row_id, source.limit_days).drop(source.snapshot)

        needed = [row_id, *([date] if as_of else []), *names]
        if not several:
            probes = rows.withColumns({n: F.col(n)[0] for n in names})
            found = look_up(probes.select(*needed)) if as_of else look_up(probes).drop(*names, *extra)
            return df.join(found.select(row_id, *values, hit), row_id, "left") if as_of else found
        # Each row once for every combination of its columns of a kind, in their order; the first that matches counts.
        probes, places = rows.select(*needed), []
        for n in several:
            places.append(f"{n}_at")
            probes = probes.select("*", F.posexplode(n).alias(f"{n}_at", f"{n}_v")).drop(n).withColumnRenamed(f"{n}_v", n)
        probes = probes.withColumns({n: F.col(n)[0] for n in names if n not in several})
        best = look_up(probes).filter(F.col(hit)).groupBy(row_id).agg(F.min(F.struct(*places, *values, hit)).alias(k))
        return df.join(best, row_id, "left").select(*df.columns, *[F.col(k)[v].alias(v) for v in [*values, hit]])

    def calculate_metrics(
        self, df: DataFrame, target: str, evaluations: Mapping[str, DataFrame] | None = None, row_id: str = "row_id", metric: str | None = None,
        folds: int = 5, estimator: object | None = None, drop_outliers: bool = True,
    ) -> DataFrame:
        """``(segment, rows, mean_target, metric, baseline, enriched, uplift, uplift_percent)`` of the training and each evaluation table.

        The training table is scored in folds, an evaluation table by a model of the whole training table; without
        and with the sources' features. Categories are encoded by the training part's target. Outliers of a regression
        target are left out of training. A table without target has no scores.
        """
        df = targets.numeric_target(df, target)
        task = self.task or targets.task_type(df, target)
        metric = metric or evaluation.default_metric(task)
        clean = df
        if drop_outliers and task == targets.REGRESSION:
            clean = enrichment.without(df, targets.outliers(df, target), [row_id])
        apart = {target, row_id, *self.keys}
        own = [c for c in df.columns if c not in apart and c not in self.dropped and c not in self._repeated(df)]
        groups = {c for cs in self.one_hot.values() for c in cs}
        sets = {"train": clean} | dict(evaluations or {})
        # Models read their rows many times.
        before = {n: d.select(row_id, target, *own).persist(StorageLevel.MEMORY_AND_DISK) for n, d in sets.items()}
        after = {n: self.transform(d, row_id).persist(StorageLevel.MEMORY_AND_DISK) for n, d in sets.items()}
        new = [c for c in after["train"].columns if c not in df.columns and c not in self.one_hot]
        all_ = [c for c in own if c not in groups] + [p for p in self.one_hot] + new
        spark, out = df.sparkSession, []
        for name in sets:
            known = before[name].filter(F.col(target).isNotNull())
            size = known.agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("m")).first()
            scores: list[float | None] = []
            for tables, features in ((before, own), (after, all_)):
                if not features or not size.n:
                    scores.append(None)
                elif name == "train":
                    folded = sampling.k_folds(tables[name], row_id, folds, name="_fold")
                    scores.append(evaluation.cross_validate(folded, features, target, task, "_fold", metric, estimator)["mean"])
                else:
                    scores.append(evaluation.fit_and_score(tables["train"], tables[name].filter(F.col(target).isNotNull()), features, target, task, metric, estimator)[0])
            base, rich = scores
            gain = evaluation.uplift(base, rich, metric) if base is not None and rich is not None else {"uplift": None, "uplift_percent": None}
            out.append((name, size.n, size.m, metric, base, rich, gain["uplift"], gain["uplift_percent"]))
        for kept in (*before.values(), *after.values()):
            kept.unpersist()
        return spark.createDataFrame(out, "segment string, rows long, mean_target double, metric string, baseline double, enriched double, uplift double, uplift_percent double")


def select_features(importance: dict[str, float], psi: dict[str, float] | None = None, keep: Sequence[str] = ()) -> list[str]:
    """Features by falling importance, then name; without those of no importance, and, if given, not in ``psi``."""
    chosen = [f for f, v in importance.items() if f in keep or (v > 0 and (psi is None or f in psi))]
    return sorted(chosen, key=lambda f: (-importance[f], f))


def with_literals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """``df`` with columns of one value each, such as a country or today's date; a name that it has is an error."""
    there = [c for c in values if c in df.columns]
    if there:
        raise ValueError(f"Columns are there already: {there}")
    return reduce(lambda d, kv: d.withColumn(kv[0], F.lit(kv[1])), values.items(), df)
