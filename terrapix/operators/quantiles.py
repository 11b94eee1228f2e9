"""Exact quantiles of whole tables, found by rank in ranges; no task holds a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 8
"""Values are dealt into ``2 ** LEVELS`` ranges."""
ACCURACY = 10_000


def bounds_of(x: Column, levels: int = LEVELS, accuracy: int = ACCURACY) -> Column:
    """Aggregate: approximate quantiles that cut a column into ``2 ** levels`` ranges of about equal counts."""
    n = 1 << levels
    return F.percentile_approx(x, F.array(*[F.lit(i / n) for i in range(1, n)]), accuracy)


def count_below(df: DataFrame, x: str, bounds: str, levels: int, out: str, equal: bool = False) -> DataFrame:
    """``df`` with the number of the ``2 ** levels - 1`` ascending ``bounds`` below ``x`` (or equal to it), by binary search.

    Each step is a projection of its own, so that the array is looked up ``levels`` times a row in compiled code.
    A null ``x`` has 0.
    """
    df = df.withColumn(out, F.lit(0))
    for k in reversed(range(levels)):
        step = 1 << k
        bound = F.get(F.col(bounds), F.col(out) + (step - 1))
        above = F.coalesce(bound <= F.col(x) if equal else bound < F.col(x), F.lit(False))
        df = df.withColumn(out, F.col(out) + F.when(above, F.lit(step)).otherwise(F.lit(0)))
    return df


def quantiles(df: DataFrame, columns: dict[str, Column], qs: list[float], by: list[str] | None = None) -> DataFrame:
    """One row (per ``by``) with an array of the quantiles ``qs``, linear between order statistics, for every name.

    Values are dealt into ranges between approximate quantiles and counted there. Only the ranges that hold one of
    the wanted ranks are looked into: their distinct values, with counts, are ranked range by range. The result is
    exact whatever the sketch says. Nulls and NaN are left out; a column without values has null. Groups are joined,
    not held, so there may be many; a table of no rows gives null arrays, or no rows with ``by``.
    """
    by = by or []
    key = [*by, "name_"]
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("name_"), c.cast("double").alias("x_")) for n, c in columns.items()]))
    long = df.select(*by, stack.alias("s_")).select(*by, "s_.name_", "s_.x_").where("x_ is not null and not isnan(x_)")
    bounds = long.groupBy(*key).agg(bounds_of(F.col("x_")).alias("q_"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    joined = long.alias("l").join((bounds if by else F.broadcast(bounds)).alias("r"), same).select("l.*", "r.q_")
    dealt = count_below(joined, "x_", "q_", LEVELS, "b_").drop("q_")
    counts = dealt.groupBy(*key, "b_").agg(F.count(F.lit(1)).alias("c_"))
    along = Window.partitionBy(*key).orderBy("b_")
    counts = counts.withColumns({"before_": F.sum("c_").over(along) - F.col("c_"), "n_": F.sum("c_").over(Window.partitionBy(*key))})
    asked = counts.select("*", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("i", "share_"))
    asked = asked.withColumn("pos", F.col("share_") * (F.col("n_") - 1))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), how("pos").cast("long").alias("at")) for side, how in ((0, F.floor), (1, F.ceil))])
    want = asked.withColumn("w_", F.explode(sides)).where("w_.at >= before_ and w_.at < before_ + c_")
    want = want.select(*key, "b_", "i", "w_.side", (F.col("w_.at") - F.col("before_")).alias("at_"), "pos")
    inner = [*key, "b_"]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in inner]
    needed = want.select(*inner).distinct()
    values = dealt.alias("l").join((needed if by else F.broadcast(needed)).alias("r"), same, "left_semi").groupBy(*inner, "x_").agg(F.count(F.lit(1)).alias("k_"))
    values = values.withColumn("to_", F.sum("k_").over(Window.partitionBy(*inner).orderBy("x_")))
    hit = values.alias("l").join((want if by else F.broadcast(want)).alias("r"), [*same, F.col("at_") < F.col("to_"), F.col("at_") >= F.col("to_") - F.col("k_")])
    hit = hit.select(*[f"l.{c}" for c in key], "x_", "i", "side", "pos").groupBy(*key, "i")
    both = hit.agg(F.max("pos").alias("p_"), F.max(F.when(F.col("side") == 0, F.col("x_"))).alias("a_"), F.max(F.when(F.col("side") == 1, F.col("x_"))).alias("z_"))
    low, high = F.floor("p_"), F.ceil("p_")
    value = F.when((low == high) | (F.col("a_") == F.col("z_")), F.col("a_")).otherwise((high - F.col("p_")) * F.col("a_") + (F.col("p_") - low) * F.col("z_"))
    lists = both.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("v_"))
    pick = [F.max(F.when(F.col("name_") == n, F.col("v_"))).alias(n) for n in columns]
    return lists.groupBy(*by).agg(*pick) if by else lists.agg(*pick)
