"""Text similarities that Spark lacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType


def jaro_winkler_of(a: str, b: str, scale: float = 0.1, prefix: int = 4) -> float:
    """The Jaro-Winkler similarity of two texts that are not empty.

    Winkler's prefix term is added to Jaro similarities over 0.7.
    """
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:prefix], b[:prefix]):
        if x != y:
            break
        same += 1
    return jaro + same * scale * (1 - jaro)


@pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    found = [None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)]
    return pd.Series(found, dtype="float64")


def jaro_winkler(a, b):
    """Jaro-Winkler as a column, in Arrow batches; null if either text is null."""
    return F.when(a.isNotNull() & b.isNotNull(), _jaro_winkler(a, b))
