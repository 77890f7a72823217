"""Operators of the formula language: traits, parameters, and the registry by which formulas find them.

A subclass declares a fixed ``name`` (and perhaps an ``alias``), or a ``pattern``
whose named groups are parameters. ``column`` makes a row-local operator;
``build`` may use windows, lookups and joins.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable
from typing import Any, ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frame import Frame

#: The name of a result column, or what adds it once the lookups that it needs are settled.
Built = str | Callable[[], str]

_NAMED: dict[str, type[Operator]] = {}
_PATTERNS: list[type[Operator]] = []


class Operator:
    name: ClassVar[str | None] = None
    alias: str | None = None
    pattern: ClassVar[str | None] = None
    #: How the operator stands in a formula, with its parameters in braces; else it is the name.
    shape: ClassVar[str | None] = None
    #: unary, binary, grouping or vector.
    kind: ClassVar[str] = "unary"
    symmetrical: ClassVar[bool] = False
    input_type: ClassVar[str | None] = None
    #: None: the type of the first operand.
    output_type: ClassVar[str | None] = None
    categorical: ClassVar[bool] = False
    vectorizable: ClassVar[bool] = False
    distribution_dependent: ClassVar[bool] = False
    time_series: ClassVar[bool] = False
    #: Whether infinite and NaN results become null.
    cleaned: ClassVar[bool] = True
    #: Parameters by name, with their defaults. The type of a default, or ``types``, says how text is read.
    defaults: ClassVar[dict[str, Any]] = {}
    types: ClassVar[dict[str, type]] = {}

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if cls.__dict__.get("abstract"):
            return
        if cls.pattern:
            _PATTERNS.append(cls)
        if cls.name and not cls.__dict__.get("unnamed"):
            _NAMED[cls.name] = cls
            if cls.alias:
                _NAMED[cls.alias] = cls

    def __init__(self, **params: Any) -> None:
        self.alias = type(self).alias
        self.extra: dict[str, Any] = {}
        for key, default in self.defaults.items():
            setattr(self, key, copy.copy(default))
        for key, value in params.items():
            self._assign(key, value)
        self.check()

    def check(self) -> None:
        """Raise ValueError for parameters that do not fit each other."""

    def _assign(self, key: str, value: Any) -> None:
        if key == "alias":
            self.alias = value
        if key not in self.defaults:
            return
        kind = self.types.get(key) or (type(self.defaults[key]) if self.defaults[key] is not None else None)
        if isinstance(value, str) and kind in (list, dict):
            value = json.loads(value)
        elif isinstance(value, str) and kind is bool:
            value = value.lower() == "true"
        elif value is not None and kind in (int, float):
            value = kind(value)
        setattr(self, key, value)

    def set_params(self, params: dict[str, Any]) -> Operator:
        """Take over the parameters that this operator has; keep all of them to give back."""
        for key, value in params.items():
            self._assign(key, value)
        self.extra = dict(params)
        self.check()
        return self

    def get_params(self) -> dict[str, Any]:
        own = {k: json.dumps(v) if isinstance(v, (list, dict)) else v for k in self.defaults if (v := getattr(self, k)) is not None}
        return {"alias": self.alias, **self.extra, **own}

    def rename_params(self, mapping: dict[str, str]) -> None:
        """Put new column names into the keys of parameters, the longest old names first."""
        out = {}
        for key, value in self.extra.items():
            for old in sorted(mapping, key=len, reverse=True):
                key = key.replace(old, mapping[old]) if old else key
            out[key] = value
        self.extra = out

    def formula(self) -> str:
        """The operator as it stands in a formula."""
        return self.shape.format_map(vars(self)) if self.shape else self.name or ""

    def hash_part(self) -> str:
        return self.formula()

    @classmethod
    def parse(cls, text: str) -> Operator | None:
        """The operator of this class that ``text`` names, for classes with a pattern."""
        m = re.fullmatch(cls.pattern or "(?!)", text)
        return cls(**{k: v for k, v in m.groupdict().items() if v is not None}) if m else None

    def column(self, *operands: Column) -> Column:
        raise NotImplementedError(f"{self.formula()} can be parsed, but has no computation")

    def build(self, frame: Frame, operands: list[str]) -> Built:
        """Compute the result in ``frame``."""
        return frame.add(self.clean(self.column(*map(F.col, operands))))

    def clean(self, c: Column) -> Column:
        return finite(c) if self.cleaned else c


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def truncated(c: Column, digits: int) -> Column:
    """``c`` cut after so many decimals, towards zero."""
    scaled = c * F.lit(float(10**digits))
    return (scaled - scaled % F.lit(1.0)) / F.lit(float(10**digits))


def find(text: str) -> Operator | None:
    """The operator that ``text`` names: by pattern first, then by name or alias."""
    for cls in _PATTERNS:
        found = cls.parse(text)
        if found is not None:
            return found
    cls = _NAMED.get(text)
    return cls() if cls else None


def register(cls: type[Operator], name: str) -> None:
    """Make a user's operator known by a further name."""
    _NAMED[name] = cls


def unregister(name: str) -> None:
    """Forget a user's operator."""
    _NAMED.pop(name, None)


def known() -> list[type[Operator]]:
    return sorted({*_NAMED.values(), *_PATTERNS}, key=lambda c: c.__name__)
