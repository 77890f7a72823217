"""Operators of any number of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.operator import Operator
from .unary import double


class Vector(Operator):
    kind, abstract = "vector", True


def _sum(columns: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(double(c), F.lit(0.0)) for c in columns])


class Mean(Vector):
    """The sum, null counting as 0, over the number of columns."""

    name, output_type = "mean", "float"

    def column(self, *columns: Column) -> Column:
        return _sum(columns) / F.lit(float(len(columns)))


class Sum(Vector):
    name = "sum"

    def column(self, *columns: Column) -> Column:
        return _sum(columns)


class Vectorize(Vector):
    name, cleaned = "vectorize", False

    def column(self, *columns: Column) -> Column:
        return F.array(*columns)


class OnnxModel(Vector):
    pattern = r"onnx_(?P<score_name>.+)"
    name, unnamed, output_type = "onnx", True, "float"
    shape, defaults = "onnx_{score_name}", {"score_name": "score"}


class CatboostModel(Vector):
    pattern = r"catboost_(?P<score_name>.+)"
    name, unnamed, output_type = "catboost", True, "float"
    shape, defaults = "catboost_{score_name}", {"score_name": "score"}
