"""Differences of dates, of lists of dates, and bins that move with the month."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StringType

from ..plans.frame import Frame
from ..plans.operator import Operator
from .unary import double

_DAY = 86_400.0
#: Parts of a second by unit of a number.
UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def to_timestamp(c: Column, kind: DataType, unit: str | None = None) -> Column:
    """A timestamp of a text, a number of ``unit`` (nanoseconds if not said), a date or a timestamp.

    What cannot be read, and what lies beyond 1677-09-21 to 2262-04-11, is null.
    """
    if isinstance(kind, NumericType):
        seconds = double(c) / F.lit(float(UNITS[unit or "ns"]))
        t = F.timestamp_micros((F.when(F.abs(seconds) < 1e11, seconds) * F.lit(1e6)).cast("long"))
    elif isinstance(kind, StringType):
        t = F.try_to_timestamp(c)
    else:
        t = c.cast("timestamp")
    return F.when((t >= F.lit("1677-09-22").cast("timestamp")) & (t < F.lit("2262-04-11").cast("timestamp")), t)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_DAY * 1e6)


class DateOperator(Operator):
    kind, abstract = "binary", True
    defaults: dict[str, Any] = {"diff_unit": "D", "left_unit": None, "right_unit": None}

    def check(self) -> None:
        if self.diff_unit not in ("D", "Y"):
            raise ValueError(f"Unsupported difference unit: {self.diff_unit}")

    def in_unit(self, days: Column) -> Column:
        return days if self.diff_unit == "D" else double((days / F.lit(365.0)).cast("long"))

    def build(self, frame: Frame, operands: list[str]) -> str:
        left, right = operands
        lt, rt = frame.type_of(left), frame.type_of(right)
        a = to_timestamp(F.col(left), lt, self.left_unit)
        return frame.add(self.clean(self.difference(a, F.col(right), rt)))

    def difference(self, left: Column, right: Column, kind: DataType) -> Column:
        raise NotImplementedError


class DateDiff(DateOperator):
    """Calendar days from the right date to the left one."""

    name, alias = "date_diff", "date_diff_type1"
    defaults = {**DateOperator.defaults, "replace_negative": False}

    def difference(self, left: Column, right: Column, kind: DataType) -> Column:
        d = self.in_unit(double(F.datediff(left, to_timestamp(right, kind, self.right_unit))))
        return F.when(d >= 0, d) if self.replace_negative else d


class DateDiffType2(DateOperator):
    """Days from the left date to the next anniversary of the right one."""

    name = "date_diff_type2"

    def difference(self, left: Column, right: Column, kind: DataType) -> Column:
        r = to_timestamp(right, kind, self.right_unit)
        years = F.year(left) - F.year(r)
        this = r + F.make_ym_interval(years, F.lit(0))
        after = r + F.make_ym_interval(years + 1, F.lit(0))
        return self.in_unit(days_between(F.when(this < left, after).otherwise(this), left))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; a column that is named several times, or in a lambda, is computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spread(x: Column) -> Column:
    return once(_mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(x))


def _median(x: Column) -> Column:
    n = F.size(x)
    return once(F.array_sort(x), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


_LIST_STATISTICS = {
    "min": F.array_min, "max": F.array_max, "mean": _mean, "average": _mean, "median": _median, "var": _spread,
    "sum": lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v),
    "std": lambda x: F.sqrt(_spread(x)), "ptp": lambda x: F.array_max(x) - F.array_min(x),
}
_COUNTS = {"count": F.size, "nunique": lambda x: F.size(F.array_distinct(x))}


class DateListDiff(DateOperator):
    """A statistic of the days from each date of a list to the left date.

    An empty list counts 0 and has no other statistic. A date that cannot be
    read counts as one value, and makes the other statistics null.
    """

    pattern = r"date_diff_(?!type)(?P<aggregation>[^_]+)"
    name, unnamed, shape = "date_diff_list", True, "date_diff_{aggregation}"
    defaults = {**DateOperator.defaults, "aggregation": None, "replace_negative": False}
    types = {"aggregation": str}

    def clean(self, c: Column) -> Column:
        return once(c, super().clean)

    def kept(self, days: Column) -> Column:
        return F.filter(days, lambda d: d > 0) if self.replace_negative else days

    def statistic(self, days: Column) -> Column:
        if self.aggregation in _COUNTS:
            return double(_COUNTS[self.aggregation](days))
        if self.aggregation not in _LIST_STATISTICS:
            raise ValueError(f"{self.aggregation} of a list is not known; {sorted([*_COUNTS, *_LIST_STATISTICS])} are")
        return F.when((F.size(days) > 0) & ~F.exists(days, lambda d: d.isNull()), _LIST_STATISTICS[self.aggregation](days))

    def difference(self, left: Column, right: Column, kind: DataType) -> Column:
        inner = kind.elementType if isinstance(kind, ArrayType) else kind
        days = once(left, lambda at: F.transform(right, lambda d: self.in_unit(days_between(at, to_timestamp(d, inner, self.right_unit)))))
        value = F.when(left.isNotNull() & right.isNotNull(), once(self.kept(days), self.statistic))
        return F.when(F.size(right) == 0, F.lit(0.0)).otherwise(value) if self.aggregation in _COUNTS else value


class DateListDiffBounded(DateListDiff):
    """The same of the differences from a lower bound to below an upper one; perhaps divided by the list's size."""

    pattern = r"date_diff_(?P<diff_unit>[^_]+)_(?:minusinf|(?P<lower_bound>\d+))_(?:plusinf|(?P<upper_bound>\d+))_(?P<aggregation>\w+?)(?P<normalize>_norm)?"
    name, unnamed = "date_diff_bounded", True
    defaults = {**DateListDiff.defaults, "lower_bound": None, "upper_bound": None, "normalize": None}
    types = {"aggregation": str, "lower_bound": int, "upper_bound": int}

    def check(self) -> None:
        super().check()
        if isinstance(self.normalize, str):
            self.normalize = self.normalize.lower() in ("_norm", "true")

    def formula(self) -> str:
        low = "minusinf" if self.lower_bound is None else self.lower_bound
        high = "plusinf" if self.upper_bound is None else self.upper_bound
        return f"date_diff_{self.diff_unit}_{low}_{high}_{self.aggregation}" + ("_norm" if self.normalize else "")

    def statistic(self, days: Column) -> Column:
        low = float("-inf") if self.lower_bound is None else float(self.lower_bound)
        high = float("inf") if self.upper_bound is None else float(self.upper_bound)
        value = once(F.filter(days, lambda d: (d >= F.lit(low)) & (d < F.lit(high))), super().statistic)
        return F.when(F.size(days) > 0, value / F.size(days)).otherwise(value) if self.normalize else value


class DatePercentile(Operator):
    """The bin of a value among bounds that move by ``step`` each month from a given one; null below all."""

    name, alias, kind, output_type, categorical, cleaned = "date_per", "date_per_method1", "binary", "category", True, False
    defaults = {"date_unit": None, "zero_month": None, "zero_year": None, "zero_bounds": [], "step": 30}
    types = {"zero_month": int, "zero_year": int}

    def build(self, frame: Frame, operands: list[str]) -> str:
        date, value = operands
        t = to_timestamp(F.col(date), frame.type_of(date), self.date_unit)
        months = 12 * (F.year(t) - F.lit(self.zero_year or 0)) + F.month(t) - F.lit(self.zero_month or 0)
        shift = double(months * F.lit(self.step))
        hits = [F.when(double(F.col(value)) >= F.lit(float(b)) + shift, F.lit(i + 1)) for i, b in enumerate(self.zero_bounds or [])]
        return frame.add(F.coalesce(*hits[::-1], F.lit(None).cast("int")))


class DatePercentileMethod2(Operator):
    name, kind, output_type, categorical = "date_per_method2", "binary", "category", True
    defaults = {"date_unit": None}
