"""Scores of predictions, models in folds by pyspark.ml, and what enrichment brings."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .ordering import FEW, average_ranks, quantiles, sums_before
from .sampling import stratified_folds


def _expected(t: Column, p: Column) -> dict[str, Column]:
    err = p - t
    log_err = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(t)
    return {
        "mae": F.avg(F.abs(err)), "mse": F.avg(err * err), "rmse": F.sqrt(F.avg(err * err)),
        "mape": F.avg(F.abs(err) / F.greatest(F.abs(t), F.lit(2.220446049250313e-16))),
        "msle": F.avg(log_err * log_err), "rmsle": F.sqrt(F.avg(log_err * log_err)), "accuracy": F.avg((t == p).cast("double")),
        "r2": F.lit(1.0) - F.avg(err * err) / F.var_pop(t),
    }


def _classes(t: Column, p: Column) -> dict[str, Column]:
    """Scores of 0 and 1 predicted."""
    hits, said, true = F.sum(t * p), F.sum(p), F.sum(t)
    missed = F.sum((1 - t) * (1 - p))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "precision": safe(hits, said), "recall": safe(hits, true), "f1": safe(2 * hits, said + true),
        "balanced_accuracy": (safe(hits, true) + safe(missed, F.sum(1 - t))) / 2,
    }


def _rest(t: Column, p: Column) -> dict[str, Column]:
    err = p - t
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return {
        "max_error": F.max(F.abs(err)), "explained_variance": F.lit(1.0) - F.try_divide(F.var_pop(err), F.var_pop(t)),
        "log_loss": -F.avg(t * F.ln(q) + (1 - t) * F.ln(1 - q)), "brier_score": F.avg(err * err),
    }


#: Scores of which more is better, and those of probabilities.
RISING = {"accuracy", "r2", "roc_auc", "gini", "precision", "recall", "f1", "balanced_accuracy", "explained_variance"}
PROBABILITIES = {"roc_auc", "gini", "log_loss", "brier_score"}
_NAMES = {
    "mean_absolute_error": "mae", "mean_squared_error": "mse", "root_mean_squared_error": "rmse", "mean_absolute_percentage_error": "mape",
    "mean_squared_log_error": "msle", "mean_squared_logarithmic_error": "msle", "root_mean_squared_log_error": "rmsle", "root_mean_squared_logarithmic_error": "rmsle",
}


def metric_name(name: str) -> str:
    """The short name of a metric: long ones and negated ones (``neg_``) are other names for it, whatever their case."""
    low = name.lower().removeprefix("neg_")
    return _NAMES.get(low, low)


def score(df: DataFrame, metric: str | Callable[[DataFrame], float], target: str, prediction: str) -> float | None:
    """A score of predictions; a callable gets the table. None for an empty table, and for a median without any value."""
    if not df.take(1):
        return None
    if callable(metric):
        return float(metric(df))
    metric = metric_name(metric)
    if metric in ("roc_auc", "gini"):
        auc = roc_auc(df, target, prediction)
        return 2 * auc - 1 if metric == "gini" else auc
    t, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    if metric == "median_absolute_error":  # a percentile as an aggregate takes all distinct errors to one task
        return next(iter(quantiles(df, F.abs(p - t), [0.5])), None)
    columns = _expected(t, p) | _classes(t, p) | _rest(t, p)
    if metric not in columns:
        raise ValueError(f"{metric} is not a metric; there are {sorted([*columns, 'median_absolute_error', 'roc_auc', 'gini'])}")
    return float(df.agg(columns[metric]).first()[0])


def roc_auc(df: DataFrame, target: str, prediction: str) -> float:
    """The area under the curve, exact with ties, from counts by distinct prediction; the driver sums up to ``FEW`` of them."""
    by = df.groupBy(F.col(prediction).alias("p")).agg(F.sum(F.col(target).cast("double")).alias("pos"), F.sum(1.0 - F.col(target).cast("double")).alias("neg"))
    few = by.limit(FEW + 1).collect()
    if len(few) <= FEW:
        u, pos, neg = 0.0, 0.0, 0.0
        for r in sorted(few, key=lambda r: (r.p is not None, r.p)):
            u, pos, neg = u + r.pos * (neg + r.neg / 2), pos + r.pos, neg + r.neg
    else:
        s = sums_before(by, "p", ["neg"]).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
        u, pos, neg = s.u, s.p, s.n
    if not pos or not neg:
        raise ValueError("roc_auc needs both classes")
    return u / (pos * neg)


def default_metric(task: str) -> str:
    return {"BINARY": "gini", "MULTICLASS": "accuracy"}.get(task, "mape")


def target_encoding(df: DataFrame, columns: Sequence[str], target: str, smoothing: float = 10.0) -> dict[str, DataFrame]:
    """``(value, encoded)`` of each column: the target's mean, drawn to the overall mean where rows are few."""
    mean = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    out = {}
    for c in columns:
        s = df.groupBy(c).agg(F.sum(F.col(target).cast("double")).alias("s"), F.count(target).alias("n"))
        out[c] = s.select(c, ((F.col("s") + F.lit(smoothing * mean)) / (F.col("n") + smoothing)).alias(f"{c}_encoded"))
    return out


def _numbers(df: DataFrame, train: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, list[str]]:
    """``df`` with features as doubles: texts by the target's mean in ``train``, unseen values by the overall mean, flags as 0 and 1."""
    texts = [f for f in features if isinstance(df.schema[f].dataType, StringType)]
    out = df
    if texts:
        mean = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
        for c, table in target_encoding(train, texts, target).items():
            out = out.join(table.withColumnRenamed(c, "_value"), F.col(c).eqNullSafe(F.col("_value")), "left").drop("_value").withColumn(f"{c}_encoded", F.coalesce(f"{c}_encoded", F.lit(mean)))
    names = [f"{f}_encoded" if f in texts else f for f in features]
    return out.select(*[F.col(n).cast("double").alias(f"_f{i}") for i, n in enumerate(names)], F.col(target).cast("double").alias("_y")), [f"_f{i}" for i in range(len(names))]


def fit_and_score(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, task: str, metric: str | Callable[[DataFrame], float], estimator: object | None = None) -> tuple[float | None, list[float]]:
    """The score on ``test`` of a model of ``train``, and the importance of each feature.

    Classes that are texts are numbered in the order of their values. Null features count as their column's mean in ``train``,
    columns without any value there as 0.
    """
    if task != "REGRESSION" and isinstance(train.schema[target].dataType, (StringType, BooleanType)):
        classes = sorted(r[0] for r in train.filter(F.col(target).isNotNull()).select(target).distinct().collect())
        code = F.array_position(F.array(*map(F.lit, classes)), F.col(target)) - 1
        train, test = train.withColumn(target, code.cast("double")), test.withColumn(target, code.cast("double"))
    (a, names), (b, _) = _numbers(train, train, features, target), _numbers(test, train, features, target)
    a = a.persist(StorageLevel.MEMORY_AND_DISK)  # read by the imputer and at each level of a tree
    try:
        return _fitted(a, b, names, task, metric, estimator)
    finally:
        a.unpersist()


def _fitted(a: DataFrame, b: DataFrame, names: list[str], task: str, metric: str | Callable[[DataFrame], float], estimator: object | None) -> tuple[float | None, list[float]]:
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    filled = a.agg(*[F.count(n).alias(n) for n in names]).first()
    empty = [n for n in names if not filled[n]]
    a, b = a.fillna(0.0, empty) if empty else a, b.fillna(0.0, empty) if empty else b
    imputer = Imputer(inputCols=names, outputCols=[f"_i{n}" for n in names]).fit(a)
    assembler = VectorAssembler(inputCols=[f"_i{n}" for n in names], outputCol="_x", handleInvalid="keep")
    kinds = {"BINARY": GBTClassifier, "MULTICLASS": RandomForestClassifier, "REGRESSION": GBTRegressor}
    maker = estimator.copy() if estimator is not None else kinds[task](seed=42)
    model = maker.setFeaturesCol("_x").setLabelCol("_y").fit(assembler.transform(imputer.transform(a.filter("_y is not null"))))
    out = model.transform(assembler.transform(imputer.transform(b)))
    out = out.withColumn("_p", vector_to_array("probability")[1] if isinstance(metric, str) and metric_name(metric) in PROBABILITIES else F.col("prediction"))
    found = getattr(model, "featureImportances", None)
    return score(out, metric, "_y", "_p"), [float(v) for v in found.toArray()] if found is not None else []


def cross_validate(df: DataFrame, features: Sequence[str], target: str, task: str, fold: str, metric: str | Callable[[DataFrame], float] | None = None, estimator: object | None = None) -> dict[str, object]:
    """Mean and spread of a score over folds, and the importance of features.

    The default estimator is gradient-boosted trees, for several classes a
    random forest. Texts are encoded by the training part's target. If a fold, or what remains without it, has one class only,
    rows are dealt anew to as many folds, class by class.
    """
    metric = metric or default_metric(task)
    rows = df.filter(F.col(fold).isNotNull() & F.col(target).isNotNull())
    counts = rows.groupBy(fold, target).count().groupBy(fold).agg(F.count("*").alias("k")).orderBy(fold).collect()
    folds = [r[0] for r in counts]
    if task != "REGRESSION" and len(folds) > 1 and min(r.k for r in counts) < 2:
        rows = stratified_folds(rows, target, F.xxhash64(*[c for c in rows.columns if c != fold]), len(folds), fold)
        folds = list(range(len(folds)))
    scores, importance = [], dict.fromkeys(features, 0.0)
    for k in folds:
        s, found = fit_and_score(rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k), features, target, task, metric, estimator)
        if s is None:
            continue
        scores.append(s)
        for f, v in zip(features, found):
            importance[f] += v / len(folds)
    if not scores:
        return {"metric": metric, "mean": None, "std": None, "scores": [], "importance": importance}
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return {"metric": metric, "mean": mean, "std": spread, "scores": scores, "importance": dict(sorted(importance.items(), key=lambda kv: (-kv[1], kv[0])))}


def uplift(baseline: float, enriched: float, metric: str) -> dict[str, float]:
    """What enrichment brings, positive if it is better, also in percent of the baseline."""
    gain = enriched - baseline if metric in RISING else baseline - enriched
    return {"baseline": baseline, "enriched": enriched, "uplift": gain, "uplift_percent": gain / abs(baseline) * 100 if baseline else math.nan}


def uplift_table(rows: Mapping[str, tuple[DataFrame, float, float]], target: str, metric: str) -> list[dict[str, object]]:
    """A row for each segment: its size, mean target, and the scores without and with enrichment."""
    out = []
    for name, (df, before, after) in rows.items():
        s = df.agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("m")).first()
        out.append({"segment": name, "rows": s.n, "mean_target": s.m, **uplift(before, after, metric)})
    return out


def _centred_ranks(rows: DataFrame, column: str, rank: str) -> DataFrame:
    """``(_v, rank)``: the average rank of each value less the mean of all ranks. To be broadcast, up to ``FEW`` values."""
    known = rows.filter(F.col(column).isNotNull())
    few = known.groupBy(column).count().limit(FEW + 1).collect()
    if len(few) > FEW:
        return average_ranks(rows, column, rank).select(F.col(column).alias("_v"), (F.col(rank) - F.lit((known.count() + 1) / 2)).alias(rank))
    table, before, middle = [], 0, (sum(r["count"] for r in few) + 1) / 2
    for value, n in sorted(tuple(r) for r in few):
        table.append((value, before + (n + 1) / 2 - middle))
        before += n
    return F.broadcast(rows.sparkSession.createDataFrame(table, f"_v double, {rank} double"))


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``(column, pearson, spearman)`` with the target, over the rows that have both. Ranks are averages over ties, from counts by value.

    Rows meet the ranks of each column, by a broadcast if it has few values. Then they are summed by the target's value,
    for all columns at once, and only these sums meet the target's ranks. Null where a side does not vary.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    x, k = [f"_x{i}" for i in range(len(columns))], range(len(columns))
    rows = df.select(*[number(c).alias(n) for c, n in zip(columns, x)], number(target).alias("_y")).filter("_y is not null")
    ranked = rows
    for i in k:
        ranked = ranked.join(_centred_ranks(rows, x[i], f"_r{i}"), F.col(x[i]) == F.col("_v"), "left").drop("_v")
    sums = [f(F.col(f"_r{i}")).alias(f"{n}{i}") for i in k for n, f in (("_n", F.count), ("_s", F.sum), ("_q", lambda r: F.sum(r * r)))]
    by = ranked.groupBy("_y").agg(*sums).persist(StorageLevel.DISK_ONLY)  # counted, cut into ranges and summed
    try:
        totals = by.agg(*[F.sum(f"_n{i}").alias(f"_n{i}") for i in k]).first()
        # Target ranks among the rows that have the column, less their mean.
        rank = lambda i: F.col(f"_n{i}_before") + (F.col(f"_n{i}") + 1) / 2.0 - F.lit(((totals[f"_n{i}"] or 0) + 1) / 2)
        products = [(F.sum(rank(i) * F.col(f"_s{i}")), F.sum(F.col(f"_q{i}")), F.sum(rank(i) * rank(i) * F.col(f"_n{i}"))) for i in k]
        got = sums_before(by, "_y", [f"_n{i}" for i in k]).agg(*[F.try_divide(xy, F.sqrt(xx * yy)).alias(f"s{i}") for i, (xy, xx, yy) in enumerate(products)]).first()
    finally:
        by.unpersist()
    # Not F.corr, which fails where a side does not vary.
    variance = lambda i: F.var_pop(x[i]) * F.var_pop(F.when(F.col(x[i]).isNotNull(), F.col("_y")))
    plain = rows.agg(*[F.try_divide(F.covar_pop(x[i], "_y"), F.sqrt(variance(i))).alias(f"p{i}") for i in k]).first()
    return df.sparkSession.createDataFrame([(c, plain[f"p{i}"], got[f"s{i}"]) for i, c in enumerate(columns)], "column string, pearson double, spearman double")


def column_order(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str) -> list[str]:
    """Keys, then columns by the greater of their correlations with the target, cut to seven decimals, then by a hash of the name."""
    got = {r["column"]: max(abs(r.pearson or 0), abs(r.spearman or 0)) for r in correlations(df, columns, target).collect()}
    tie = {c: hashlib.sha256(c.encode()).hexdigest() for c in columns}
    return [*keys, *sorted(columns, key=lambda c: (-math.trunc((0 if math.isnan(got[c]) else got[c]) * 1e7), tie[c]))]


def drift(train: DataFrame, evaluations: Mapping[str, DataFrame], columns: Sequence[str], most: int = 5) -> list[dict[str, object]]:
    """Of each evaluation table: how well its rows are told from the training rows by the best single column, and the ``most`` such columns.

    0.5 is not at all, 1 is wholly. Null values take no part.
    """
    out = []
    for name, table in evaluations.items():
        side = lambda d, v: d.select(*[F.col(c).cast("double").alias(c) for c in columns], F.lit(v).alias("_side"))
        both = side(train, 0.0).unionByName(side(table, 1.0))
        auc = {}
        for c in columns:
            known = both.filter(F.col(c).isNotNull())
            if known.select("_side").distinct().count() == 2:
                a = roc_auc(known, "_side", c)
                auc[c] = max(a, 1 - a)
        order = sorted(auc, key=lambda c: (-auc[c], c))
        out.append({"segment": name, "drift_auc": auc[order[0]] if order else None, "features": order[:most]})
    return out
