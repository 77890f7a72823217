"""What kind of time structure a table has, and the cross-validation that suits it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .targets import REGRESSION

#: Fewest dates and least density of a blocked series; share of its dates that have several rows.
LEAST_DATES, LEAST_DENSITY, SEVERAL = 270, 0.3, 0.99
#: Targets of the learners by kind of task that a user may name as loss.
LOSSES = {
    "REGRESSION": set("gamma huber mape mean_absolute_percentage_error poisson quantile regression regression_l1 tweedie".split()),
    "BINARY": {"binary"}, "MULTICLASS": set("multiclass multiclass_ova multiclassova ova ovr".split()),
}
#: What pyspark.ml's boosted trees offer for them.
_TREE_LOSS = {"regression": "squared", "regression_l1": "absolute", "mape": "absolute", "mean_absolute_percentage_error": "absolute", "binary": "logistic"}


def is_time_series(df: DataFrame, date: str) -> bool:
    """Whether every date has equally many rows and dates follow each other at one calendar distance."""
    at = F.col(date).cast("timestamp")
    counts = df.groupBy(at.alias("t")).agg(F.count("*").alias("n"))
    s = counts.agg(F.count_distinct("n").alias("kinds"), F.max(F.col("t").isNull()).alias("missing")).first()
    if s.missing or s.kinds != 1:
        return False
    before = F.lag("t").over(Window.orderBy("t"))
    months = F.months_between("t", before)
    whole = months == F.floor(months)
    gap = F.when(whole, F.concat(F.lit("m"), months.cast("int"))).otherwise(F.concat(F.lit("s"), F.unix_micros("t") - F.unix_micros(before)))
    return counts.withColumn("gap", gap).filter("gap is not null").select("gap").distinct().limit(2).count() == 1


def is_blocked_time_series(df: DataFrame, date: str, keys: Sequence[str] = ()) -> bool:
    """Whether a table of days is dense, with several rows nearly every day that differ in few columns."""
    at, columns = F.col(date).cast("timestamp"), [c for c in df.columns if c != date and c not in keys]
    rows = df.withColumn("_day", F.date_trunc("DAY", at)).withColumn("_time", F.unix_micros(at) - F.unix_micros("_day"))
    s = rows.agg(F.count_distinct(at).alias("dates"), F.count_distinct("_time").alias("times"), (F.datediff(F.max(at), F.min(at)) + 1).alias("days")).first()
    if s.times > 1 or s.dates < LEAST_DATES or s.dates / s.days < LEAST_DENSITY:
        return False
    per = rows.groupBy(at.alias("_t")).agg(F.count("*").alias("_n"), *[(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(f"c{i}") for i, c in enumerate(columns)])
    t = per.agg(F.avg((F.col("_n") > 1).cast("double")).alias("several"), *[F.max(f"c{i}").alias(f"c{i}") for i in range(len(columns))]).first()
    if t.several < SEVERAL:
        return False
    return len(columns) <= 2 or sum(t[f"c{i}"] > 1 for i in range(len(columns))) <= 2


def dates_are_even(df: DataFrame, date: str) -> bool:
    """Whether days of the later half have about as many rows as those of the earlier one (0.8 to 1.2 times)."""
    days = df.filter(F.col(date).isNotNull()).groupBy(F.to_date(F.col(date).cast("timestamp")).alias("d")).agg(F.count("*").alias("n"))
    n = days.count()
    if n <= 1:
        return True
    late = F.row_number().over(Window.orderBy("d")) > round(n / 2)
    s = days.withColumn("late", late).agg(F.avg(F.when(F.col("late"), F.col("n"))).alias("b"), F.avg(F.when(~F.col("late"), F.col("n"))).alias("a")).first()
    return 0.8 <= s.b / s.a <= 1.2


def group_columns(df: DataFrame, keys: Mapping[str, str]) -> list[str]:
    """Columns whose values must not be torn apart by folds: of the first kind there is, else all that vary but dates."""
    for kind in ("phone", "email", "hem", "ip"):
        found = [c for c, k in keys.items() if k == kind]
        if found:
            return found
    rest = [c for c, k in keys.items() if k not in ("date", "datetime") and c in df.columns]
    if not rest:
        return []
    s = df.agg(*[F.count_distinct(c).alias(f"c{i}") for i, c in enumerate(rest)]).first()
    return [c for i, c in enumerate(rest) if s[f"c{i}"] > 1]


def cross_validation(df: DataFrame, keys: Mapping[str, str], task: str, target: str, chosen: str | None = None) -> str:
    """``blocked_time_series`` for regression on a blocked series, ``group_k_fold`` for classification, else ``k_fold``, unless chosen."""
    if chosen:
        return chosen
    date = next((c for c, k in keys.items() if k in ("date", "datetime")), None)
    persons = {"phone", "email", "hem"} & set(keys.values())
    if task == REGRESSION and date and not persons and is_blocked_time_series(df, date, [*(c for c in keys if c != date), target]):
        return "blocked_time_series"
    return "k_fold" if task == REGRESSION else "group_k_fold"


def tree_loss(loss: str, task: str) -> str:
    """The loss of boosted trees for a named one; an error if the task or the learner does not have it."""
    if loss not in LOSSES.get(task, set()):
        raise ValueError(f"{loss} is no loss for {task}; there are {sorted(LOSSES.get(task, set()))}")
    if loss not in _TREE_LOSS:
        raise ValueError(f"Boosted trees have no loss for {loss}; there are {sorted(_TREE_LOSS)}")
    return _TREE_LOSS[loss]
