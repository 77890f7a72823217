"""Formulas: a tree of operators over columns, read from and written to text.

``(a/b)``, ``abs(x)``, ``GroupByThenMin(value,key)`` and ``roll_3D_mean(date,value)``
are formulas. Infix operators stand in parentheses. A column name may not
contain any of ``()+-*/,``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

from .. import operators as _operators  # noqa: F401  makes the operators known
from .operator import Operator, find

_SPECIAL = "()+-*/,"
_INFIX = "+-*/"


@dataclass
class Leaf:
    """A column."""

    name: str

    def formula(self, **_: Any) -> str:
        return self.name

    pretty = display_name = formula

    def columns(self) -> list[str]:
        return [self.name]

    def rename(self, mapping: dict[str, str]) -> Leaf:
        self.name = mapping.get(self.name, self.name)
        return self

    def set_params(self, params: dict[str, Any]) -> Leaf:
        return self

    def get_params(self) -> dict[str, str]:
        return {}

    def result_type(self, types: dict[str, str]) -> str:
        return types[self.name]

    def nodes(self) -> Iterator[Leaf | Call]:
        yield self


@dataclass
class Call:
    """An operator applied to operands."""

    op: Operator
    operands: list[Leaf | Call]
    alias: str | None = None
    index: str | None = field(default=None)

    def formula(self, **_: Any) -> str:
        inner = [o.formula() for o in self.operands]
        if self.op.name in tuple(_INFIX):
            return f"({inner[0]}{self.op.name}{inner[1]})"
        return f"{self.op.formula()}({','.join(inner)})"

    def pretty(self) -> str:
        inner = [o.pretty() for o in self.operands]
        if self.op.name in tuple(_INFIX):
            return f" {self.op.name} ".join(inner)
        return f"{self.op.formula()}({', '.join(inner)})"

    def columns(self) -> list[str]:
        """The columns used, each once, in order."""
        return list(dict.fromkeys(c for o in self.operands for c in o.columns()))

    def nodes(self) -> Iterator[Leaf | Call]:
        for o in self.operands:
            yield from o.nodes()
        yield self

    def operator_names(self) -> set[str]:
        return {n.op.formula() for n in self.nodes() if isinstance(n, Call)}

    def rename(self, mapping: dict[str, str]) -> Call:
        for o in self.operands:
            o.rename(mapping)
        return self

    def rename_params(self, mapping: dict[str, str]) -> Call:
        for n in self.nodes():
            if isinstance(n, Call):
                n.op.rename_params(mapping)
        return self

    def display_name(self, shorten: bool = False, op_alias: bool = True, **_: Any) -> str:
        """The name of the feature: its columns and operator, or the last operand's name with the operator stacked on it."""
        op = (self.op.alias or self.op.formula()).lower() if op_alias else self.op.formula()
        stacks = (self.op.kind == "unary" or self.op.time_series) and isinstance(self.operands[-1], Call)
        if self.alias:
            parts = ["f_autofe", self.alias]
        elif stacks:
            parts = [self.operands[-1].display_name(shorten=shorten, op_alias=op_alias), op]
        elif shorten and self.op.kind != "unary":
            parts = ["f_autofe", op]
        else:
            parts = ["f_" + "_f_".join(self.columns()), "autofe", op]
        return "_".join([*parts, *([str(self.index)] if self.index is not None else [])])

    def digest(self) -> str:
        """Ten hexadecimal digits that tell features apart."""
        inner = [o.op.hash_part() for o in self.operands if isinstance(o, Call)]
        text = "_".join([self.op.hash_part(), *inner, *(o.display_name() for o in self.operands)])
        return hashlib.sha256(text.encode()).hexdigest()[:10]

    def identity(self) -> str:
        """Equal for equal computations, parameters included."""
        inner = ",".join(o.identity() if isinstance(o, Call) else repr(o.name) for o in self.operands)
        params = sorted((k, str(getattr(self.op, k))) for k in self.op.defaults)
        return f"{type(self.op).__name__}{params}({inner})"

    def set_params(self, params: dict[str, Any]) -> Call:
        """Set parameters of this operator, and of operands by the prefix of their names (all of them if none has it)."""
        self.op.set_params(params)
        for o in self.operands:
            head = o.display_name()
            own = {key.removeprefix(head)[1:]: value for key, value in params.items() if key.startswith(head)}
            o.set_params(own or params)
        return self

    def get_params(self) -> dict[str, str]:
        """This operator's parameters as text, and the operands' with their names as prefixes."""
        out = {f"{o.display_name()}_{k}": v for o in self.operands for k, v in o.get_params().items()}
        return {k: str(v) for k, v in {**out, **self.op.get_params()}.items() if v is not None}

    def result_type(self, types: dict[str, str]) -> str:
        return self.op.output_type or self.operands[0].result_type(types)


def parse(text: str) -> Leaf | Call:
    """Read a formula; ValueError if it is none or names an unknown operator."""
    node, at = _read(text, 0)
    if at != len(text):
        raise ValueError(f"Unsupported column name: {text}. Column names should not have characters: {list(_SPECIAL)}")
    return node


def _word(text: str, at: int) -> int:
    while at < len(text) and text[at] not in _SPECIAL:
        at += 1
    return at


def _expect(text: str, at: int, sign: str) -> int:
    if text[at : at + 1] != sign:
        raise ValueError(f"Malformed formula {text}: expected '{sign}' at {at}")
    return at + 1


def _read(text: str, at: int) -> tuple[Leaf | Call, int]:
    if text[at : at + 1] == "(":
        left, mid = _read(text, at + 1)
        sign = text[mid : mid + 1]
        if not sign or sign not in _INFIX:
            raise ValueError(f"Unsupported operand: {sign}")
        right, end = _read(text, mid + 1)
        return Call(_operator(sign), [left, right]), _expect(text, end, ")")
    end = _word(text, at)
    if end == at:
        raise ValueError(f"Malformed formula {text}: nothing at {at}")
    if text[end : end + 1] != "(":
        return Leaf(text[at:end]), end
    op, operands = _operator(text[at:end]), []
    while True:
        node, end = _read(text, end + 1)
        operands.append(node)
        if text[end : end + 1] != ",":
            return Call(op, operands), _expect(text, end, ")")


def _operator(text: str) -> Operator:
    op = find(text)
    if op is None:
        raise ValueError(f"Unsupported operand: {text}")
    return op


def uses_same_columns(left: Leaf | Call, right: Leaf | Call) -> bool:
    return set(left.columns()) == set(right.columns())


def batches(nodes: Iterable[Leaf | Call]) -> list[list[Leaf | Call]]:
    """Consecutive features of one vectorizable operator and one main column (the last operand) together."""

    def key(n: Leaf | Call) -> Any:
        if isinstance(n, Call) and n.op.vectorizable:
            return n.op.formula(), n.operands[-1].formula() if len(n.operands) > 1 else ""
        return id(n)

    return [list(g) for _, g in groupby(nodes, key)]
