"""The operators of the formula language, and table operators (joins, cleaning, sampling, stability)."""

from . import binary, dates, grouping, timeseries, unary, vector  # noqa: F401  they register themselves
