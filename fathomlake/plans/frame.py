"""A DataFrame under construction: pending columns and lookups are added in as few plan steps as possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


class Frame:
    """Collects expressions; ``settle`` adds all pending ones at once.

    Window expressions of one ``settle`` that share partitioning share its
    shuffle. Aggregates that are looked up by the same key share one
    aggregation and one join. Added columns have names that the table lacks.
    """

    def __init__(self, df: DataFrame, row_id: str | None = None) -> None:
        self.df = df
        self.row_id = row_id
        self._pending: dict[str, Column] = {}
        self._lookups: dict[tuple[str, ...], dict[str, Column]] = {}
        self._taken = {c.lower() for c in df.columns}
        self._n = 0

    def name(self) -> str:
        while True:
            self._n += 1
            name = f"_c{self._n}"
            if name not in self._taken:
                self._taken.add(name)
                return name

    def add(self, expression: Column) -> str:
        """A row-local or window expression over settled columns."""
        name = self.name()
        self._pending[name] = expression
        return name

    def lookup(self, keys: tuple[str, ...], aggregate: Column) -> str:
        """An aggregate by ``keys``, given back to each row; null where a key is null.

        No key: one value for the table. The join's strategy is left to Spark.
        """
        name = self.name()
        self._lookups.setdefault(keys, {})[name] = aggregate
        return name

    def replace(self, df: DataFrame) -> None:
        """Go on with a table that has the settled columns and more."""
        self.df = df

    def settle(self) -> None:
        if self._pending:
            pending, self._pending = self._pending, {}
            self.df = self.df.withColumns(pending)
        lookups, self._lookups = self._lookups, {}
        base = self.df
        for keys, aggregates in lookups.items():
            aggs = [a.alias(n) for n, a in aggregates.items()]
            if not keys:
                self.df = self.df.crossJoin(F.broadcast(base.agg(*aggs)))  # a single row
                continue
            other = {k: self.name() for k in keys}
            found = base.filter(_all_present(keys)).groupBy(*[F.col(k).alias(other[k]) for k in keys]).agg(*aggs)
            on = [F.col(k) == F.col(o) for k, o in other.items()]
            self.df = self.df.join(found, on, "left").drop(*other.values())

    def type_of(self, name: str) -> DataType:
        self.settle()
        return self.df.schema[name].dataType

    def ordering(self) -> Column:
        if self.row_id is None:
            raise ValueError("this operator takes the first of equal rows, so it needs a row_id column")
        return F.col(self.row_id)


def _all_present(names: tuple[str, ...]) -> Column:
    out = F.col(names[0]).isNotNull()
    for n in names[1:]:
        out = out & F.col(n).isNotNull()
    return out
