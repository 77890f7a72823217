"""Formulas on streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import features
from ..plans.formula import Call, parse

#: What a tumbling or sliding window can compute with bounded state.
WINDOW_STATISTICS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp}


def stream_features(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """Row-local formulas on a stream. Fitted operators need their parameters; others are an error."""
    for text in formulas.values():
        for node in parse(text).nodes():
            if isinstance(node, Call) and (node.op.distribution_dependent or node.op.time_series or (node.op.name == "norm" and node.op.norm is None)):
                raise ValueError(f"{node.op.formula()} looks at other rows; use windowed() or a fitted parameter")
    return features(df, formulas)


def windowed(df: DataFrame, at: str, value: str, groups: list[str], length: str, slide: str | None = None, late: str = "1 hour", statistics: tuple[str, ...] = ("mean", "count")) -> DataFrame:
    """Statistics of a value by event-time window and group; rows later than ``late`` are dropped by the watermark."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    aggs = [WINDOW_STATISTICS[s](value).alias(f"{value}_{s}") for s in statistics]
    out = df.withWatermark(at, late).groupBy(window.alias("w"), *groups).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *groups, *[f"{value}_{s}" for s in statistics])
