"""Operators of two columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler
from ..plans.frame import Frame
from ..plans.operator import Built, Operator, finite
from .unary import double


class Binary(Operator):
    kind, abstract = "binary", True


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


class Min(Binary):
    name, symmetrical = "min", True

    def column(self, a: Column, b: Column) -> Column:
        return _both(a, b, F.least(double(a), double(b)))


class Max(Binary):
    name, symmetrical = "max", True

    def column(self, a: Column, b: Column) -> Column:
        return _both(a, b, F.greatest(double(a), double(b)))


class Add(Binary):
    name, alias, symmetrical, vectorizable = "+", "add", True, True

    def column(self, a: Column, b: Column) -> Column:
        return double(a) + double(b)


class Subtract(Binary):
    name, alias, vectorizable = "-", "sub", True

    def column(self, a: Column, b: Column) -> Column:
        return double(a) - double(b)


class Multiply(Binary):
    name, alias, symmetrical, vectorizable = "*", "mul", True, True

    def column(self, a: Column, b: Column) -> Column:
        return double(a) * double(b)


class Divide(Binary):
    name, alias, vectorizable, output_type = "/", "div", True, "float"

    def column(self, a: Column, b: Column) -> Column:
        return F.try_divide(double(a), double(b))


class Combine(Binary):
    """Both values as one text, joined by an underscore; null if either is."""

    name, output_type, cleaned = "Combine", "object", False

    def column(self, a: Column, b: Column) -> Column:
        return F.concat(a.cast("string"), F.lit("_"), b.cast("string"))


class CombineThenFreq(Binary):
    """The share of the pair of values among rows that have both."""

    name, input_type, output_type, symmetrical, distribution_dependent = "CombineThenFreq", "discrete", "float", True, True

    def build(self, frame: Frame, operands: list[str]) -> Built:
        a, b = map(F.col, operands)
        both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
        own = frame.lookup(tuple(dict.fromkeys(operands)), F.count(both))
        all_ = frame.lookup((), F.count(both))
        return lambda: frame.add(_both(a, b, double(F.col(own)) / F.col(all_)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null for a null or zero vector, a null element, or vectors of unlike sizes."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.lit(1.0) - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


class Distance(Binary):
    name, output_type, symmetrical = "dist", "float", True

    def column(self, a: Column, b: Column) -> Column:
        return cosine_distance(a, b)


class Sim(Binary):
    name, output_type, symmetrical = "sim", "float", True

    def column(self, a: Column, b: Column) -> Column:
        return F.lit(1.0) - finite(cosine_distance(a, b))


class StringSim(Binary):
    """A similarity of texts, null if either is null or empty."""

    abstract, input_type, output_type, symmetrical = True, "string", "float", True

    def column(self, a: Column, b: Column) -> Column:
        return self.similarity(F.nullif(a.cast("string"), F.lit("")), F.nullif(b.cast("string"), F.lit("")))

    def similarity(self, a: Column, b: Column) -> Column:
        raise NotImplementedError


class JaroWinklerSim1(StringSim):
    name = "sim_jw1"

    def similarity(self, a: Column, b: Column) -> Column:
        return jaro_winkler(a, b)


class JaroWinklerSim2(StringSim):
    """Jaro-Winkler from the ends of the texts."""

    name = "sim_jw2"

    def similarity(self, a: Column, b: Column) -> Column:
        return jaro_winkler(F.reverse(a), F.reverse(b))


class LevenshteinSim(StringSim):
    name = "sim_lv"

    def similarity(self, a: Column, b: Column) -> Column:
        return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
