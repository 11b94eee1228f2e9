"""Column functions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r4(col: Column | str, places: int = 4) -> Column:
    """A double rounded for output, without a negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, places) + F.lit(0.0)


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def least_strict(*columns: Column) -> Column:
    """The least value, null if any is null (``least`` skips nulls)."""
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in columns]), None).otherwise(F.least(*columns))


def class_by(col: Column, breaks: Column, low: int = 0) -> Column:
    """``low`` plus the number of sorted ``breaks`` that lie below ``col``; the lowest class includes its edge."""
    return F.when(col.isNotNull(), F.size(F.filter(breaks, lambda b: b < col)) + low).cast("int")
