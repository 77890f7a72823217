"""What kind of task a target makes, and whether its classes are balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BINARY, MULTICLASS, REGRESSION = "BINARY", "MULTICLASS", "REGRESSION"
#: Rows from which a binary target may be imbalanced; most classes; share of an even class below which one is rare.
BINARY_ROWS, MOST_CLASSES, RARE = 5000, 100, 0.6


def present(df: DataFrame, target: str) -> Column:
    t = F.col(target)
    if isinstance(df.schema[target].dataType, NumericType):
        return t.isNotNull() & ~F.isnan(t.cast("double")) & (F.abs(t.cast("double")) != float("inf"))
    return t.isNotNull() & (t.cast("string") != "")


def task_type(df: DataFrame, target: str, has_date: bool = False) -> str:
    """The kind of task, from one aggregation. No value, or one value only, is an error."""
    rows = df.filter(present(df, target)).select(F.col(target).alias("t"), F.col(target).cast("string").try_cast("double").alias("x"))
    whole = F.col("x") == F.floor("x")
    s = rows.agg(
        F.count("*").alias("n"), F.count_distinct("t").alias("distinct"), F.count("x").alias("numbers"), F.count_distinct("x").alias("values"),
        F.min("x").alias("low"), F.max("x").alias("high"), F.bool_and(whole).alias("whole"), F.count(F.when(F.col("x") != 0, 1)).alias("nonzero"),
        F.count_distinct(F.when(F.col("x") != 0, F.col("x"))).alias("nonzero_values"),
    ).first()
    if s.n == 0:
        raise ValueError("The target is empty")
    if s.distinct == 1:
        raise ValueError("The target is constant")
    if s.distinct == 2:
        return BINARY
    if s.numbers < s.n:
        return MULTICLASS
    coded = s.whole and s.low in (0, 1) and s.high - s.low + 1 == s["values"]
    if s["values"] <= 50 and coded:
        return MULTICLASS
    if has_date or not s.whole or s.nonzero_values > 50 or s.nonzero_values > 0.2 * s.nonzero:
        return REGRESSION
    return MULTICLASS


def is_imbalanced(df: DataFrame, target: str, task: str) -> bool:
    """Whether the rarest class has less than 0.6 of an even share. Call it on deduplicated rows."""
    if task == REGRESSION:
        return False
    s = df.filter(F.col(target).isNotNull()).groupBy(target).count().agg(F.sum("count").alias("n"), F.count("*").alias("k"), F.min("count").alias("least")).first()
    if task == BINARY and (s.n or 0) <= BINARY_ROWS:
        return False
    if (s.k or 0) > MOST_CLASSES:
        raise ValueError(f"The target has {s.k} classes; the most is {MOST_CLASSES}")
    return bool(s.k) and s.least < RARE / s.k * s.n


def numeric_target(df: DataFrame, target: str, least_numbers: float = 0.95) -> DataFrame:
    """Texts that are mostly numbers as numbers, the rest null; else classes of one row become null."""
    if isinstance(df.schema[target].dataType, NumericType):
        return df
    x = F.col(target).try_cast("double")
    s = df.agg(F.count(target).alias("n"), F.count(x).alias("x")).first()
    if s.n and s.x >= least_numbers * s.n:
        return df.withColumn(target, x)
    common = df.groupBy(target).count().filter("count > 1").select(F.col(target).alias("_t"))
    return df.join(common, F.col(target) == F.col("_t"), "left").withColumn(target, F.col("_t")).drop("_t")


def outliers(df: DataFrame, target: str, distances: float = 5.0) -> DataFrame:
    """Rows of a regression target more than so many standard deviations from the mean, the farthest first."""
    s = df.agg(F.avg(target).alias("m"), F.stddev_samp(target).alias("s"))
    far = F.abs(F.col(target) - F.col("m"))
    return df.crossJoin(F.broadcast(s)).filter(far > distances * F.col("s")).orderBy(far.desc()).drop("m", "s")
