"""Formulas to DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formula import Call, Leaf, parse
from .frame import Frame


def features(df: DataFrame, formulas: Sequence[str | Leaf | Call] | Mapping[str, str | Leaf | Call], row_id: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with a column for each formula, named by the mapping or by the feature's display name.

    Formulas are compiled together: equal subtrees are computed once, and what
    lies on the same level of the trees is added in one step, so that windows and
    aggregates of equal keys are shared. ``row_id`` names a column with the order of rows; operators
    that take the first of equal rows need it. ``keep`` limits the columns of
    ``df`` in the result.
    """
    if isinstance(formulas, Mapping):
        trees = {name: parse(f) if isinstance(f, str) else f for name, f in formulas.items()}
    else:
        nodes = [parse(f) if isinstance(f, str) else f for f in formulas]
        trees = {n.display_name(): n for n in nodes}
    before = list(df.columns if keep is None else keep)
    used = dict.fromkeys([*before, *([row_id] if row_id else []), *(c for t in trees.values() for c in t.columns())])
    frame = Frame(df.select(*[F.col(_quoted(c)) for c in used]), row_id)
    done: dict[str, str] = {}
    calls = {n.identity(): n for t in trees.values() for n in t.nodes() if isinstance(n, Call)}
    depth: dict[str, int] = {}
    for key, n in calls.items():  # operands come before what uses them
        depth[key] = 1 + max((depth[o.identity()] for o in n.operands if isinstance(o, Call)), default=0)
    for level in range(1, max(depth.values(), default=0) + 1):
        later = {}
        for key, n in calls.items():
            if depth[key] == level:
                names = [done[o.identity()] if isinstance(o, Call) else o.name for o in n.operands]
                built = n.op.build(frame, names)
                if callable(built):
                    later[key] = built
                else:
                    done[key] = built
        frame.settle()
        done.update({key: add() for key, add in later.items()})
        frame.settle()
    out = [F.col(done[t.identity()] if isinstance(t, Call) else _quoted(t.name)).alias(name) for name, t in trees.items()]
    return frame.df.select(*[F.col(_quoted(c)) for c in before], *out)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
