"""Statistics of a value by a key, given back to each row.

They are aggregations that are joined back by key, not windows: partial
aggregation shrinks the data before the shuffle, and a frequent key does not
put all of its rows into one task. A null key gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.frame import Frame
from ..plans.operator import Built, Operator, finite
from .unary import double


class Grouping(Operator):
    kind, abstract, distribution_dependent = "grouping", True, True


def _statistic(agg: str, x: str, frame: Frame) -> Column:
    c = F.col(x)
    simple = {
        "min": F.min, "max": F.max, "mean": F.avg, "avg": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "count": F.count,
        "std": F.stddev_samp, "var": F.var_samp, "median": lambda c: F.percentile(c, F.lit(0.5)),
        "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)), "prod": F.product, "skew": _skew,
    }
    if agg in simple:
        return simple[agg](double(c)) if agg != "count" else F.count(c).cast("double")
    if agg in ("first", "last"):
        pick = F.min_by if agg == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), frame.ordering()))
    raise ValueError(f"Unsupported aggregation: {agg}")


def _skew(c: Column) -> Column:
    """Skewness with the correction for samples; 0 for equal values, null below three of them."""
    n = F.count(c)
    return F.when((n > 2) & (F.min(c) == F.max(c)), 0.0).when(n > 2, F.skewness(c) * F.sqrt(double(n) * (n - 1)) / (n - 2))


class GroupByThenAgg(Grouping):
    pattern = r"GroupByThen(?P<agg>(?!(?:[Rr]ank|[Nn]unique|NUnique|[Ff]req)$)[A-Za-z]+)"
    name, unnamed, vectorizable = "GroupByThenAgg", True, True
    shape, defaults, types = "GroupByThen{agg}", {"agg": None}, {"agg": str}

    def check(self) -> None:
        if self.agg:
            self.agg = self.agg[0].upper() + self.agg[1:]

    def build(self, frame: Frame, operands: list[str]) -> Built:
        value, key = operands
        return frame.lookup((key,), _statistic(self.agg.lower(), value, frame))


class GroupByThenRank(Grouping):
    """The share of the group's values that are at most this one, ties counting half their number and a half more."""

    name, vectorizable, output_type = "GroupByThenRank", True, "float"

    def build(self, frame: Frame, operands: list[str]) -> Built:
        frame.settle()
        value, key = operands
        v, k, share = frame.name(), frame.name(), frame.name()
        counts = frame.df.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
        counts = counts.groupBy(F.col(key).alias(k), F.col(value).alias(v)).agg(F.count("*").alias("n"))
        below = F.sum("n").over(Window.partitionBy(k).orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("n").over(Window.partitionBy(k))
        ranks = counts.select(k, v, ((double(below) - (double(F.col("n")) - 1.0) / 2.0) / total).alias(share))
        joined = frame.df.join(ranks, (F.col(key) == F.col(k)) & (F.col(value) == F.col(v)), "left").drop(k, v)
        frame.replace(joined)
        return share


class GroupByThenNUnique(Grouping):
    name, vectorizable, input_type, output_type = "GroupByThenNUnique", True, "discrete", "int"

    def build(self, frame: Frame, operands: list[str]) -> Built:
        frame.settle()
        value, key = operands
        k, found = frame.name(), frame.name()
        counts = frame.df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(k)).agg(F.count_distinct(value).alias(found))
        frame.replace(frame.df.join(counts, F.col(key) == F.col(k), "left").drop(k))
        return found


class GroupByThenFreq(Grouping):
    """The share of the value among the group's values that are not null."""

    name, input_type, output_type = "GroupByThenFreq", "discrete", "float"

    def build(self, frame: Frame, operands: list[str]) -> Built:
        value, key = operands
        own, all_ = frame.lookup(tuple(dict.fromkeys((key, value))), F.count(value)), frame.lookup((key,), F.count(value))
        return lambda: frame.add(F.when(F.col(value).isNotNull(), finite(F.try_divide(double(F.col(own)), double(F.col(all_))))))
