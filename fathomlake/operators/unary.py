"""Operators of one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.frame import Frame
from ..plans.operator import Built, Operator, finite, truncated


def double(c: Column) -> Column:
    return c.cast("double")


def floor(x: Column) -> Column:
    """The floor as a double, also beyond the range of a long."""
    return F.when(F.abs(x) < F.lit(2.0**53), double(F.floor(x))).otherwise(x)


class Abs(Operator):
    name, vectorizable = "abs", True

    def column(self, x: Column) -> Column:
        return F.abs(double(x))


class Log(Operator):
    """The natural logarithm of the absolute value, to ten decimals; null at 0."""

    name, vectorizable, output_type = "log", True, "float"

    def column(self, x: Column) -> Column:
        return truncated(F.ln(F.abs(F.nullif(double(x), F.lit(0.0)))), 10)


class Sqrt(Operator):
    name, vectorizable, output_type = "sqrt", True, "float"

    def column(self, x: Column) -> Column:
        return truncated(F.sqrt(F.abs(double(x))), 15)


class Square(Operator):
    name, vectorizable = "square", True

    def column(self, x: Column) -> Column:
        return double(x) * double(x)


class Sigmoid(Operator):
    name, vectorizable, output_type = "sigmoid", True, "float"

    def column(self, x: Column) -> Column:
        return truncated(F.lit(1.0) / (F.lit(1.0) + F.exp(-double(x))), 15)


class Floor(Operator):
    name, vectorizable, input_type, output_type = "floor", True, "continuous", "int"

    def column(self, x: Column) -> Column:
        return floor(double(x))


class Residual(Operator):
    name, vectorizable, input_type = "residual", True, "continuous"

    def column(self, x: Column) -> Column:
        return double(x) - floor(double(x))


class Freq(Operator):
    """The share of the value among the values that are not null."""

    name, input_type, output_type, distribution_dependent = "freq", "discrete", "float", True

    def build(self, frame: Frame, operands: list[str]) -> Built:
        x = operands[0]
        own, all_ = frame.lookup((x,), F.count(x)), frame.lookup((), F.count(x))
        return lambda: frame.add(F.when(F.col(x).isNotNull(), double(F.col(own)) / F.col(all_)))


class Norm(Operator):
    """The value divided by the column's Euclidean norm, or by the norm fitted before."""

    name, output_type = "norm", "float"
    defaults, types = {"norm": None}, {"norm": float}

    def build(self, frame: Frame, operands: list[str]) -> Built:
        x = double(F.col(operands[0]))
        if self.norm is not None:
            return frame.add(finite(F.try_divide(x, F.lit(float(self.norm)))))
        fitted = frame.lookup((), F.sqrt(F.sum(x * x)))
        return lambda: frame.add(finite(F.try_divide(x, F.col(fitted))))


class Bin(Operator):
    """The place, from 1, of the last bound that the value reaches; -1 below all and for null."""

    name, output_type, categorical, cleaned = "bin", "category", True, False
    defaults = {"bin_bounds": []}

    def column(self, x: Column) -> Column:
        reached = [F.when(double(x) >= F.lit(float(b)), F.lit(i + 1)) for i, b in enumerate(self.bin_bounds)]
        if not reached:
            return F.lit(-1)
        return F.coalesce(*reached[::-1], F.lit(-1))


class Embeddings(Operator):
    name, input_type, output_type = "emb", "string", "vector"


class Cluster(Operator):
    name, input_type, output_type, categorical = "cluster", "vector", "category", True


class OutlierDistance(Operator):
    pattern = r"outlier_dist(?:_(?P<class_value>.+))?"
    name, unnamed, input_type, output_type = "outlier_dist", True, "vector", "float"
    defaults = {"class_value": None}

    def formula(self) -> str:
        return "outlier_dist" + (f"_{self.class_value}" if self.class_value is not None else "")
