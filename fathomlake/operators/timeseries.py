"""Operators of time series: date, group columns, value.

A series holds one row for each group and date: the first of the table, by
``row_id``. Results go back to every row of that group and date; a null or
unreadable date, or a null group, gives null.

Nothing is joined. The rows of a series are a window partition, and a row's
peers have its date, so frames by range see whole dates; rows that are not the
first of their date take part as null. All operators over the same groups share
one shuffle. Without group columns the whole table is one series, hence one task.
"""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.frame import Frame
from ..plans.operator import Operator, find, finite
from .dates import to_timestamp
from .unary import double

#: Microseconds of the units that windows may have. Calendar units have no fixed length.
UNITS = {"D": 86_400_000_000, "d": 86_400_000_000, "H": 3_600_000_000, "h": 3_600_000_000, "T": 60_000_000, "S": 1_000_000, "s": 1_000_000}
_OFFSET = r"(?:_offset_(?P<offset_size>\d+)(?P<offset_unit>[a-zA-Z]))?"


def micros(size: int, unit: str) -> int:
    if unit not in UNITS:
        raise ValueError(f"Invalid unit: {unit}. Must be one of {sorted(UNITS)}")
    return size * UNITS[unit]


class Series:
    """Column expressions over a settled (live row, time, value) series."""

    def __init__(self, frame: Frame, groups: list[str], at: str, live: str, value: str) -> None:
        self.frame, self.groups, self.at, self.live, self.value = frame, groups, at, live, value

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*(self.groups or [F.lit(0)])).orderBy(self.at)

    @property
    def group(self) -> WindowSpec:
        return Window.partitionBy(*(self.groups or [F.lit(0)]))

    def range(self, begin: int, end: int) -> WindowSpec:
        """Times from ``begin`` to ``end`` microseconds after each row's."""
        return self.spec.rangeBetween(begin, end)

    def trailing(self, length: int) -> WindowSpec:
        return self.range(1 - length, 0)

    @property
    def v(self) -> Column:
        return F.when(F.col(self.live), F.col(self.value))

    def with_value(self, value: Column) -> Series:
        name = self.frame.add(value)
        self.frame.settle()
        return Series(self.frame, self.groups, self.at, self.live, name)

    def exactly(self, shift: int) -> Column:
        """A struct of the live row's value that long before, null if there is no such row."""
        return F.max(F.when(F.col(self.live), F.struct(F.col(self.value).alias("v")))).over(self.range(-shift, -shift))

    def own(self) -> Column:
        """The value of the row's date, also for rows that are not the first of it."""
        return self.exactly(0)["v"]

    def lagged(self, size: int, unit: str) -> Column:
        """The oldest value from before ``size`` units back to ``size + 1`` units back."""
        window = self.range(1 - micros(size + 1, unit), -micros(size, unit))
        oldest = F.first(F.when(F.col(self.live), F.struct(F.col(self.value).alias("v"))), ignorenulls=True).over(window)
        # As a window of size + 1 units it also needs some value in it.
        return F.when(F.count(self.v).over(self.trailing(micros(size + 1, unit))) > 0, oldest["v"])


class TimeSeries(Operator):
    kind, abstract, time_series = "vector", True, True
    defaults: dict[str, Any] = {"date_unit": None, "offset_size": 0, "offset_unit": "D"}

    def check(self) -> None:
        micros(1, self.offset_unit)

    def formula(self) -> str:
        return super().formula() + (f"_offset_{self.offset_size}{self.offset_unit}" if self.offset_size > 0 else "")

    def series(self, frame: Frame, date: str, groups: list[str], value: str, among: Column | None = None) -> Series:
        """The series of the rows ``among``, shifted by the offset: a row has the value of the date
        that long before, and rows without such a date drop out."""
        at = frame.add(F.unix_micros(to_timestamp(F.col(date), frame.type_of(date), self.date_unit)))
        frame.settle()
        present = F.col(at).isNotNull()
        for g in groups:
            present = present & F.col(g).isNotNull()
        if among is not None:
            present = present & among
        # Partitioned like all that follows, and sorted more finely, so this costs no shuffle or sort of its own.
        rows = Window.partitionBy(*(groups or [F.lit(0)]), *([present] if among is not None else [])).orderBy(at, frame.ordering())
        live = frame.add(present & ~F.lag(at).over(rows).eqNullSafe(F.col(at)))
        number = frame.add(finite(F.expr(f"try_cast(`{value}` AS DOUBLE)")))
        frame.settle()
        s = Series(frame, groups, at, live, number)
        if self.offset_size > 0:
            partner = frame.add(s.exactly(micros(self.offset_size, self.offset_unit)))
            frame.settle()
            live = frame.add(F.col(live) & F.col(partner).isNotNull())
            number = frame.add(F.col(partner)["v"])
            frame.settle()
            s = Series(frame, groups, at, live, number)
        return s

    def build(self, frame: Frame, operands: list[str]) -> str:
        date, *groups, value = operands
        s = self.series(frame, date, groups, value)
        result = frame.add(self.result(s))
        frame.settle()
        present = F.max(F.col(s.live)).over(s.range(0, 0))  # rows of a date that dropped out have no result
        known = F.col(s.at).isNotNull()
        for g in groups:
            known = known & F.col(g).isNotNull()
        return frame.add(F.when(known & present, finite(F.col(result))))

    def result(self, s: Series) -> Column:
        raise NotImplementedError


def _sample_skew(n: Column, var: Column, skew: Column) -> Column:
    """Of a population's skewness, null where it does not vary."""
    return F.when((n > 2) & (var > 1e-14), skew * F.sqrt(n * (n - 1)) / (n - 2))


def _sample_kurt(n: Column, var: Column, kurt: Column) -> Column:
    """Of a population's excess kurtosis."""
    return F.when((n > 3) & (var > 1e-14), ((n * n - 1.0) * (kurt + 3.0) - 3.0 * (n - 1) * (n - 1)) / ((n - 2) * (n - 3)))


class Roll(TimeSeries):
    """A statistic of the values of a trailing time window, open at its old end."""

    pattern = r"roll_(?P<window_size>\d+)(?P<window_unit>[a-zA-Z])_(?P<aggregation>\w+?)" + _OFFSET
    name, unnamed, shape = "roll", True, "roll_{window_size}{window_unit}_{aggregation}"
    defaults = {**TimeSeries.defaults, "aggregation": None, "window_size": 1, "window_unit": "D"}
    types = {"aggregation": str}

    def check(self) -> None:
        super().check()
        micros(1, self.window_unit)

    def result(self, s: Series) -> Column:
        w, v = s.trailing(micros(self.window_size, self.window_unit)), s.v
        over = lambda c: c.over(w)
        # Moments about the mean: differences of sums of powers lose the digits of values that are far from 0.
        moments = lambda f: (double(over(F.count(v))), over(F.var_pop(v)), over(f(v)))
        q = lambda p: over(F.percentile(v, F.lit(p)))
        kinds = {
            "mean": lambda: over(F.avg(v)), "sum": lambda: over(F.sum(v)), "min": lambda: over(F.min(v)), "max": lambda: over(F.max(v)),
            "count": lambda: F.when(over(F.count(v)) > 0, double(over(F.count(v)))), "std": lambda: over(F.stddev_samp(v)), "var": lambda: over(F.var_samp(v)),
            "sem": lambda: over(F.stddev_samp(v)) / F.sqrt(F.nullif(over(F.count(v)) - 1, F.lit(0))), "median": lambda: q(0.5), "q25": lambda: q(0.25), "q75": lambda: q(0.75),
            "iqr": lambda: q(0.75) - q(0.25), "norm_mean": lambda: F.try_divide(s.own(), over(F.avg(v))),
            "skew": lambda: _sample_skew(*moments(F.skewness)), "kurt": lambda: _sample_kurt(*moments(F.kurtosis)),
        }
        if self.aggregation not in kinds:
            raise ValueError(f"{self.aggregation} of a window is not known; {sorted(kinds)} are")
        return kinds[self.aggregation]()


class Lag(TimeSeries):
    pattern = r"lag_(?P<lag_size>\d+)(?P<lag_unit>[a-zA-Z])" + _OFFSET
    name, unnamed, shape = "lag", True, "lag_{lag_size}{lag_unit}"
    defaults, types = {**TimeSeries.defaults, "lag_size": 1, "lag_unit": "D"}, {}

    def check(self) -> None:
        super().check()
        micros(1, self.lag_unit)

    def result(self, s: Series) -> Column:
        return s.lagged(self.lag_size, self.lag_unit)


class Delta(TimeSeries):
    """The value less its lag."""

    pattern = r"delta_(?P<delta_size>\d+)(?P<delta_unit>[a-zA-Z])" + _OFFSET
    name, unnamed, shape = "delta", True, "delta_{delta_size}{delta_unit}"
    defaults = {**TimeSeries.defaults, "delta_size": 1, "delta_unit": "D"}

    def check(self) -> None:
        super().check()
        micros(1, self.delta_unit)

    def result(self, s: Series) -> Column:
        return s.own() - s.lagged(self.delta_size, self.delta_unit)


class Delta2(Delta):
    """The delta of the delta."""

    pattern = r"delta2_(?P<delta_size>\d+)(?P<delta_unit>[a-zA-Z])" + _OFFSET
    name, unnamed, shape = "delta2", True, "delta2_{delta_size}{delta_unit}"

    def result(self, s: Series) -> Column:
        return super().result(s.with_value(super().result(s)))


class TrendCoefficient(TimeSeries):
    """The slope of the values over steps of a regular grid, for each group; 0 if there is none.

    A grid point has the value of the last row up to it; missing values are
    filled from the next one. The sums over grid points follow from how many of
    them each row stands for, so the grid is never made.
    """

    pattern = r"trend_coef" + _OFFSET
    name, unnamed, shape = "trend_coef", True, "trend_coef"
    defaults = {**TimeSeries.defaults, "step_size": 1, "step_unit": "D"}

    def result(self, s: Series) -> Column:
        frame, step = s.frame, micros(self.step_size, self.step_unit)
        at = F.when(F.col(s.live), F.col(s.at))
        begin = frame.add(F.min(at).over(s.group))
        end = frame.add(F.max(at).over(s.group))
        upcoming = frame.add(F.min(at).over(s.range(1, Window.unboundedFollowing)))
        frame.settle()
        day = UNITS["D"]
        zero = F.floor(F.col(begin) / F.lit(day)) * F.lit(day)  # the grid is anchored at the first day's midnight
        origin = zero + F.floor((F.col(begin) - zero) / F.lit(step)) * F.lit(step)
        place = lambda t: F.ceil((t - origin) / F.lit(float(step)))  # noqa: E731  of the first grid point from t on
        last = F.floor((F.col(end) - origin) / F.lit(float(step)))
        own, past = double(place(F.col(s.at))), double(F.least(F.coalesce(place(F.col(upcoming)), last + 1), last + 1))
        a, b = frame.add(F.when(F.col(s.live) & (past > own), own)), frame.add(F.when(F.col(s.live) & (past > own), past))
        frame.settle()
        # Rows that stand for grid points; points before the first of these take its value.
        filled = frame.add(F.first(F.when(F.col(a).isNotNull(), s.v), ignorenulls=True).over(s.range(0, Window.unboundedFollowing)))
        least = frame.add(F.min(a).over(s.group))
        frame.settle()
        a, b = F.when(F.col(a) == F.col(least), F.lit(0.0)).otherwise(F.col(a)), F.col(b)
        n, y = b - a, F.col(filled)
        index = (b - a) * (a + b - 1) / 2
        total = lambda c: F.sum(F.when(b.isNotNull(), c)).over(s.group)
        squares = lambda k: (k - 1) * k * (2 * k - 1) / 6
        missing = F.max(F.when(b.isNotNull(), y.isNull())).over(s.group)
        count, sx, sy, sxy, sxx = total(n), total(index), total(n * y), total(index * y), total(squares(b) - squares(a))
        slope = F.try_divide(count * sxy - sx * sy, count * sxx - sx * sx)
        return F.when(missing, F.lit(0.0)).otherwise(F.coalesce(finite(slope), F.lit(0.0)))


class Volatility(TimeSeries):
    abstract = True
    defaults: dict[str, Any] = {**TimeSeries.defaults, "step_size": 1, "step_unit": "D"}

    def returns(self, s: Series) -> Series:
        """Changes relative to exactly one step before, missing values taken from before; 0 without a partner."""
        filled = s.with_value(F.last(s.v, ignorenulls=True).over(s.spec.rangeBetween(Window.unboundedPreceding, 0)))
        past = filled.exactly(micros(self.step_size, self.step_unit))["v"]
        now = F.col(filled.value)
        change = F.when((past == 0) & (now != 0), F.lit(None)).otherwise(F.coalesce(F.try_divide(now, past) - 1, F.lit(0.0)))
        return filled.with_value(change)

    def volatility(self, s: Series, size: int, unit: str, absolute: bool = False) -> Column:
        r = self.returns(s)
        if absolute:
            r = r.with_value(F.abs(F.col(r.value)))
        return F.stddev_samp(r.v).over(r.trailing(micros(size, unit)))


class RollingVolatility(Volatility):
    """The standard deviation of returns in a trailing window."""

    pattern = r"roll_vol_(?P<window_size>\d+)(?P<window_unit>[a-zA-Z])" + _OFFSET
    name, unnamed, shape = "roll_vol", True, "roll_vol_{window_size}{window_unit}"
    defaults = {**Volatility.defaults, "window_size": 1, "window_unit": "D", "abs_returns": False}

    def result(self, s: Series) -> Column:
        return self.volatility(s, self.window_size, self.window_unit, self.abs_returns)


class RollingVolatility2(Volatility):
    """The volatility of the volatility (of absolute returns)."""

    pattern = r"roll_vol2_(?P<window_size>\d+)(?P<window_unit>[a-zA-Z])" + _OFFSET
    name, unnamed, shape = "roll_vol2", True, "roll_vol2_{window_size}{window_unit}"
    defaults = {**Volatility.defaults, "window_size": 1, "window_unit": "D"}

    def result(self, s: Series) -> Column:
        once = s.with_value(self.volatility(s, self.window_size, self.window_unit, True))
        return self.volatility(once, self.window_size, self.window_unit)


class VolatilityRatio(Volatility):
    """Short-term by long-term volatility; 1 where that is undefined."""

    pattern = r"vol_ratio_(?P<short_window_size>\d+)(?P<short_window_unit>[a-zA-Z])_to_(?P<window_size>\d+)(?P<window_unit>[a-zA-Z])" + _OFFSET
    name, unnamed, shape = "vol_ratio", True, "vol_ratio_{short_window_size}{short_window_unit}_to_{window_size}{window_unit}"
    defaults = {**Volatility.defaults, "window_size": 1, "window_unit": "D", "short_window_size": 1, "short_window_unit": "D"}

    def result(self, s: Series) -> Column:
        r = self.returns(s)
        short, long = (F.stddev_samp(r.v).over(r.trailing(micros(n, u))) for n, u in ((self.short_window_size, self.short_window_unit), (self.window_size, self.window_unit)))
        return F.coalesce(finite(F.try_divide(short, long)), F.lit(1.0))


def ewm_std(x: np.ndarray, span: int) -> np.ndarray:
    """The bias-corrected, exponentially weighted standard deviation up to each entry, which may be NaN."""
    keep = 1.0 - 2.0 / (span + 1.0)
    out, w, w2, mean, square = np.full(len(x), np.nan), 0.0, 0.0, 0.0, 0.0
    for i, value in enumerate(x):
        w, w2, square = w * keep, w2 * keep * keep, square * keep
        if not np.isnan(value):
            # Weighted updating of mean and squared deviation.
            w, w2 = w + 1.0, w2 + 1.0
            gap = value - mean
            mean += gap / w
            square += gap * (value - mean)
        if w > 0 and w * w - w2 > 1e-12 * w * w:
            out[i] = np.sqrt(max(square / w * w * w / (w * w - w2), 0.0))
    return out


class EWMAVolatility(Volatility):
    """The exponentially weighted standard deviation of returns; weights go by place, not by time.

    It is a recursion along the series, so each group is handed to Python once, in Arrow batches.
    """

    pattern = r"ewma_vol_(?P<window_size>\d+)" + _OFFSET
    name, unnamed, shape = "ewma_vol", True, "ewma_vol_{window_size}"
    defaults = {**Volatility.defaults, "window_size": 1}

    def result(self, s: Series) -> Column:
        r = self.returns(s)
        frame, name, span = s.frame, s.frame.name(), self.window_size
        at, live, value = r.at, r.live, r.value

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g[name] = np.nan
            rows = g[g[live].astype(bool)].sort_values(at)
            by_time = pd.Series(ewm_std(rows[value].to_numpy(dtype=float), span), index=rows[at])
            g[name] = g[at].map(by_time).astype(float)
            return g

        schema = StructType([*frame.df.schema.fields, StructField(name, DoubleType())])
        frame.replace(frame.df.groupBy(*s.groups).applyInPandas(lambda g: run(g), schema))
        return F.col(name)


class CrossSeriesInteraction(TimeSeries):
    """A binary operator between two series of one table, told apart by the values of descriptor columns.

    Series are aligned on date and the other group columns. The result stands in
    the rows of both; other rows are null.
    """

    pattern = r"cross_(?P<interaction_op>.+?)" + _OFFSET
    name, unnamed, shape = "cross", True, "cross_{{}}"
    defaults = {**TimeSeries.defaults, "interaction_op": None, "descriptor_indices": [], "left_descriptor": [], "right_descriptor": []}

    def check(self) -> None:
        super().check()
        if isinstance(self.interaction_op, str):
            self.interaction_op = find(self.interaction_op)
        if not self.descriptor_indices:
            raise ValueError("descriptor_indices cannot be empty")
        for side in ("left_descriptor", "right_descriptor"):
            if len(getattr(self, side)) != len(self.descriptor_indices):
                raise ValueError(f"{side} must have a value for each of descriptor_indices")

    @classmethod
    def parse(cls, text: str) -> Operator | None:
        m = re.fullmatch(cls.pattern, text)
        op = find(m["interaction_op"]) if m else None
        if op is None or op.kind != "binary":
            return None
        given = {k: v for k, v in m.groupdict().items() if v is not None and k != "interaction_op"}
        return cls(interaction_op=op, descriptor_indices=[0], left_descriptor=["default"], right_descriptor=["default"], **given)

    def _inner(self) -> str:
        inner = self.interaction_op
        return inner.alias or inner.formula()

    def formula(self) -> str:
        return super().formula().replace("{}", self._inner())

    def get_params(self) -> dict[str, Any]:
        return {**super().get_params(), "interaction_op": self._inner()}

    def hash_part(self) -> str:
        return "_".join([self.formula(), *map(str, self.descriptor_indices), *self.left_descriptor, *self.right_descriptor])

    def build(self, frame: Frame, operands: list[str]) -> str:
        date, *groups, value = operands
        rest = [o for i, o in enumerate(operands[1:-1], 1) if i not in self.descriptor_indices]

        def among(descriptor: list[str]) -> Column:
            out = F.lit(True)
            for i, v in zip(self.descriptor_indices, descriptor):
                out = out & F.coalesce(F.col(operands[i]).cast("string") == F.lit(v), F.lit(False))
            return out

        sides, values = [among(self.left_descriptor), among(self.right_descriptor)], []
        for rows in sides:
            s = self.series(frame, date, groups, value, rows)
            values.append(Series(frame, rest, s.at, s.live, s.value).own())
        left, right = (frame.add(v) for v in values)
        frame.settle()
        known = F.col(s.at).isNotNull() & (sides[0] | sides[1])
        for g in groups:
            known = known & F.col(g).isNotNull()
        return frame.add(F.when(known, finite(self.interaction_op.column(F.col(left), F.col(right)))))
