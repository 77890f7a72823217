"""Names for helper columns that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(*tables: DataFrame, wanted: str) -> list[str]:
    """Names like those wanted (space-separated) that no column of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    out = []
    for name in wanted.split():
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
