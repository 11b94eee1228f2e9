"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
SHARE = 1000
"""A key is hot if it has more than one in 1000 of the rows; so there are fewer than 1000 hot keys at any size."""


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, salts: int = SALTS) -> DataFrame:
    """(keys, salts_) of the hot keys of a table of counts by key; fewer than ``SHARE`` rows, so fit to be broadcast."""
    total = counts.agg(F.sum(count_col).alias("all_"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col(count_col) * SHARE > F.col("all_"))
    return hot.select(*keys, F.lit(salts).alias("salts_"))


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``other``, which has a key once or a few times, by ``keys`` without nulls.

    ``rows`` of a hot key are dealt by a hash of ``spread`` over as many parts as the key has salts, and
    ``other``'s row of that key is copied to each of the parts; rows of other keys have part 0.
    """
    marked = rows.join(F.broadcast(hot), keys, "left")
    part = F.when(F.col("salts_").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(9), spread), F.col("salts_")).cast("int"))
    left = marked.withColumn("part_", part).drop("salts_")
    copies = other.join(F.broadcast(hot), keys, "left")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts_"), F.lit(1)) - 1))
    right = copies.withColumn("part_", parts).drop("salts_")
    return left.join(right, [*keys, "part_"], how).drop("part_")
