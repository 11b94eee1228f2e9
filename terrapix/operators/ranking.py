"""Ordered operators: de-duplication, distributed running sums, efficiency scores and priority ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import t_critical
from ..sources.tables import stored
from .quantiles import LEVELS, bounds_of, count_below, quantiles

FEW = 4096
"""Groups up to which small tables by group are broadcast: at most 4096 * 65 * 65 rows, of groups with many ties."""


FEW_ROWS = 10_000
"""Rows of a group that one task may hold at the end of :func:`first_rows`: as many from each of its ``PARTS`` parts."""
PARTS = 64


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def dedup_prefer(df: DataFrame, keys: list[str], column: str, preferred: int, order: list[str]) -> DataFrame:
    """One row of every key: one with the preferred value if there is any, else the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy((F.col(column) == preferred).desc(), *order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def _number(key: Column, kind: str) -> Column:
    """A number that never falls along a key: the key itself, or the first seven bytes of a text; null for other kinds."""
    if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return key.cast("double")
    if kind == "string":
        return F.conv(F.hex(F.rpad(F.substring(key.cast("binary"), 1, 7), F.lit(7), F.lit(b"\x00"))), 16, 10).cast("double")
    return F.lit(None).cast("double")


def ranked_prefix(
    df: DataFrame, order: str, key: str, values: list[str], descending: bool = True, by: list[str] | None = None, levels: int = 6, groups: int | None = None, share: int = 1
) -> DataFrame:
    """``df`` with ``rank`` (from 1), ``n`` and ``cum_<value>`` along a total order, without sorting in one task.

    Rows are dealt into ``2 ** levels`` ranges of the order column, whose bounds are approximate quantiles; each range
    is summed and ranked by itself and then shifted by the totals of the ranges before it, a small table per group. A
    value that fills whole ranges is dealt further into ranges of the key (of a text by its first bytes). The order is
    the column (``descending`` or not), then the key. Null order values come last. Columns of the names that are added
    are replaced.

    Bounds and totals are broadcast if ``groups``, the number of groups ``by``, is at most ``FEW`` (counted if not
    given), else joined as Spark sees fit. With ``share`` the bounds come from every ``share``-th key, which only
    tells how rows are dealt.

    ``df`` is read in several passes, which must see the same order values: sums and means of doubles may differ in the
    last bit from pass to pass, as shuffled parts arrive in any order, and have to be ``stored`` first.
    """
    by = by or []
    used = {order, key, *values, *by}
    df = df.drop(*[c for c in ("rank", "n", *[f"cum_{v}" for v in values]) if c in df.columns and c not in used])
    if by and groups is None:
        groups = df.select(*by).distinct().limit(FEW + 1).count()
    small = F.broadcast if not by or groups <= FEW else lambda x: x
    buckets = 1 << levels
    x = F.col(order).cast("double")
    keyed = df.withColumns({"x_": -x if descending else x, "y_": F.lit(None).cast("double") if key == order else _number(F.col(key), dict(df.dtypes)[key])})
    seen = keyed if share == 1 else keyed.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0)
    bounds = seen.groupBy(*by).agg(bounds_of(F.col("x_"), levels, 1000).alias("q_"), bounds_of(F.col("y_"), levels, 1000).alias("kq_"))
    keyed = keyed.join(small(bounds), by, "left") if by else keyed.crossJoin(small(bounds))
    for column, array, closed, out in (("x_", "q_", False, "b_"), ("x_", "q_", True, "e_"), ("y_", "kq_", False, "p_")):
        keyed = count_below(keyed, column, array, levels, out, closed)
    alone = F.col("x_").isNull() | F.col("q_").isNull()
    full = (alone | (F.col("e_") - F.col("b_") > 1)) & F.col("y_").isNotNull() & F.col("kq_").isNotNull()
    keyed = keyed.withColumns({"b_": F.when(alone, F.lit(buckets)).otherwise(F.col("b_")), "p_": F.when(full, F.col("p_") + 1).otherwise(0)}).drop("q_", "kq_", "e_", "y_")
    inside = Window.partitionBy(*by, "b_", "p_").orderBy(F.col("x_").asc_nulls_last(), F.col(key).asc())
    sums = keyed.groupBy(*by, "b_", "p_").agg(F.count("*").alias("c_"), *[F.sum(v).alias(f"s_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("b_", "p_").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*by, "b_", "p_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("c0_"), F.sum("c_").over(Window.partitionBy(*by)).alias("n"), *[F.coalesce(F.sum(f"s_{v}").over(before), F.lit(0)).alias(f"o_{v}") for v in values])
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumns({"rank": F.row_number().over(inside), **{f"cum_{v}": F.coalesce(F.sum(v).over(running), F.lit(0)) for v in values}})
    joined = local.join(small(shift), [*by, "b_", "p_"])
    return joined.withColumns({"rank": F.col("rank") + F.col("c0_"), **{f"cum_{v}": F.col(f"cum_{v}") + F.col(f"o_{v}") for v in values}}).drop("b_", "p_", "x_", "c0_", *[f"o_{v}" for v in values])


def first_rows(df: DataFrame, n: int, order: str, key: str, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (of every group ``by``) in the order of a column, then the key.

    Up to ``FEW_ROWS`` rows: the first ones of each of ``PARTS`` parts of a group, then the first of those, so that no task
    sorts a group; parts are cut by a hash of the whole row, so rows that share a key spread too. More: those of all
    rows, stored once, as :func:`first_stored` finds them; those of groups by ranks in ranges.
    """
    if n > FEW_ROWS:
        return ranked_prefix(df, order, key, [], descending=False, by=by).where(F.col("rank") <= n).select(*df.columns) if by else first_stored(stored(df, "first"), n, order, key)
    by = by or []
    parts = df.withColumn("part_", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
    for keys in ([*by, "part_"], by):
        w = Window.partitionBy(*keys).orderBy(order, key)
        parts = parts.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")
    return parts.select(*df.columns)


def first_stored(df: DataFrame, n: int, order: str, key: str) -> DataFrame:
    """The first ``n`` rows of a table that is cheap to read again, in the order of a number (null last), then the key.

    Approximate quantiles bracket the ``n``-th row: rows before the bracket are filtered, and those within it are looked
    at in the same way until few are wanted, so that the table is neither shuffled nor sorted. Counts prove the bracket;
    a bracket of one value is ranked by the key.
    """
    if n <= 0:
        return df.limit(0)
    if n <= FEW_ROWS:
        return first_rows(df, n, order, key)
    x = F.col(order).cast("double")
    total, bounds = df.agg(F.count(x), bounds_of(x, LEVELS)).first()
    at = n * (1 << LEVELS) // max(total, 1)
    low, high = (bounds or [])[max(at - 2, 0) :][:1], (bounds or [])[at + 1 :][:1]
    before = x < low[0] if low and at >= 2 else F.lit(False)
    upto = x <= high[0] if high else x.isNotNull()
    first, last = df.agg(F.count_if(before), F.count_if(upto)).first()
    if low == high or not first <= n <= last or last - first == total:
        return ranked_prefix(df, order, key, [], descending=False).where(F.col("rank") <= n).select(*df.columns)
    return df.where(before).union(first_stored(df.where(upto & ~before), n - first, order, key))


def cumulative_curve(df: DataFrame, order: str, value: str, key: str) -> DataFrame:
    """(rank, pct, cumulative) along descending ``order``, with the point (0, 0, 0)."""
    curve = ranked_prefix(df, order, key, [value]).select(F.col("rank").cast("long").alias("rank"), (F.col("rank") / F.col("n") * 100).alias("pct"), F.col(f"cum_{value}").cast("double").alias("cumulative"))
    return curve.union(df.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)))


def performance_efficiency(df: DataFrame, order: str, density: str, key: str, area: str = "area_m2") -> DataFrame:
    """Area under the cumulative curve of density times hectares, per hectare; the trapezoids in closed form."""
    ha = F.col(area) / 1e4
    ranked = ranked_prefix(df.withColumn("v_", F.col(density) * ha), order, key, [])
    return ranked.agg((F.sum(F.col("v_") * (F.col("n") - F.col("rank") + 0.5) / F.col("n")) / F.sum(ha)).alias("efficiency"))


def cross_sort_scores(df: DataFrame, metrics: list[str], key: str, area: str = "area_m2") -> DataFrame:
    """Efficiency of every metric under the order of every metric: (sorted_by, target, efficiency)."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("sorted_by"), F.col(m).cast("double").alias("o")) for m in metrics]))
    long = df.select(key, F.col(area).alias("a_"), *metrics, stack.alias("s")).select(key, "a_", *metrics, "s.sorted_by", "s.o")
    ranked = ranked_prefix(long, "o", key, [], by=["sorted_by"], groups=len(metrics))
    ha = F.col("a_") / 1e4
    weight = ha * (F.col("n") - F.col("rank") + 0.5) / F.col("n")
    wide = ranked.groupBy("sorted_by").agg(*[(F.sum(F.col(m) * weight) / F.sum(ha)).alias(m) for m in metrics])
    return wide.unpivot(["sorted_by"], metrics, "target", "efficiency")


def score_spread(scores: DataFrame) -> DataFrame:
    """Mean, deviation, coefficient of variation and 95 % t interval of each order's efficiencies relative to the targets' own order."""
    own = scores.where("sorted_by = target").select("target", F.col("efficiency").alias("own"))
    rel = scores.join(own, "target").withColumn("rel", F.try_divide("efficiency", "own"))
    out = rel.groupBy("sorted_by").agg(F.avg("rel").alias("mean"), F.stddev("rel").alias("sd"), F.count("rel").alias("n_"))
    half = t_critical(F.col("n_") - 1) * F.col("sd") / F.sqrt("n_")
    return out.withColumns({"cv": F.try_divide("sd", "mean"), "half_": half}).withColumns({"low": F.col("mean") - F.col("half_"), "high": F.col("mean") + F.col("half_")}).drop("n_", "half_")


def capacity_target(df: DataFrame, order: str, target: float, capacity: str, totals: list[str], key: str, area: str = "area_m2") -> DataFrame:
    """What the first rows by ``order`` that reach a capacity amount to: rows, hectares, capacity and totals."""
    ranked = ranked_prefix(df, order, key, [capacity])
    chosen = ranked.where(F.col(f"cum_{capacity}") - F.col(capacity) < target)
    return chosen.agg(F.count("*").alias("cells"), F.sum(F.col(area) / 1e4).alias("hectares"), F.sum(capacity).alias("capacity"), *[F.sum(c).alias(c) for c in totals])


def demand_cutoff(df: DataFrame, demand: DataFrame, group: str, order: str, power: str, key: str) -> DataFrame:
    """Rows of every group in descending order, flagged once the power before them meets the group's demand."""
    ranked = ranked_prefix(df, order, key, [power], by=[group])
    joined = ranked.join(demand, group)
    return joined.withColumn("beyond", F.col(f"cum_{power}") - F.col(power) >= F.col("demand"))


def demand_met(flagged: DataFrame, group: str, power: str) -> DataFrame:
    """By group: rows needed, power in all, whether the demand is met and what lacks."""
    out = flagged.groupBy(group).agg(F.count_if(~F.col("beyond")).alias("needed"), F.sum(power).alias("power"), F.first("demand").alias("demand"))
    return out.withColumns({"met": F.col("power") >= F.col("demand"), "lacking": F.greatest(F.col("demand") - F.col("power"), F.lit(0.0))})


def state_integrals(df: DataFrame, state: str, orders: list[str], metrics: list[str], area: str = "area_m2", step: float = 0.5) -> DataFrame:
    """By state and order: area under the running sum of metric times hectares over bins of global percentiles.

    Bins are closed at both ends, so a value on an edge counts in both, and a run of equal edges in all bins between.
    The running sum and its trapezoids are linear in the bins' sums, and the bins of a value are a run, so that a
    row's weight has a closed form and one aggregate does without a window. A row's places among the edges, a small
    array, are looked up once in an Arrow batch: as column expressions, the search is too much code for one stage.
    """
    m = round(100 / step)
    found = quantiles(df, {o: F.col(o) for o in orders}, [1 - i / m for i in reversed(range(m + 1))]).first()
    edges = [np.array(found[o] if found[o] else [np.inf], np.float64) for o in orders]  # m + 1 numbers an order

    @F.pandas_udf("array<int>")
    def places(values: pd.DataFrame) -> pd.Series:
        """For each order the numbers of edges below its value and up to it; null values have -1."""
        out = np.full((len(values), 2 * len(edges)), -1, np.int32)
        for i, e in enumerate(edges):
            x = values.iloc[:, i].to_numpy(np.float64)
            known = ~np.isnan(x)
            out[known, 2 * i], out[known, 2 * i + 1] = np.searchsorted(e, x[known], "left"), np.searchsorted(e, x[known], "right")
        return pd.Series(list(out))

    asked = df.select(state, (F.col(area) / 1e4).alias("ha_"), *metrics, places(F.struct(*[F.col(o).cast("double").alias(f"x{i}") for i, o in enumerate(orders)])).alias("at_"))
    stack = F.explode(F.array(*[F.struct(F.lit(o).alias("sorted_by"), F.get("at_", F.lit(2 * i)).alias("lo_"), F.get("at_", F.lit(2 * i + 1)).alias("hi_")) for i, o in enumerate(orders)]))
    long = asked.withColumn("s_", stack).select(state, "ha_", *metrics, "s_.*").where("lo_ >= 0")
    first, last = F.greatest(F.col("lo_") - 1, F.lit(0)), F.least(F.col("hi_") - 1, F.lit(m - 1))
    n = last - first + 1
    weight = ((first + last) * n / 2 + n / 2 - F.when(last == m - 1, 0.5).otherwise(0.0)) / (m - 1)
    return long.groupBy(state, "sorted_by").agg(*[F.sum(F.col(x) * F.col("ha_") * weight).alias(x) for x in metrics])


def improvement_vs_others(integrals: DataFrame, state: str, best: str, metrics: list[str]) -> DataFrame:
    """By state and metric: percentage by which the order ``best`` beats each other order; mean, deviation, error."""
    long = integrals.unpivot([state, "sorted_by"], metrics, "metric", "v")
    own = long.where(F.col("sorted_by") == best).select(state, "metric", F.col("v").alias("own"))
    gain = long.where(F.col("sorted_by") != best).join(own, [state, "metric"]).withColumn("gain", F.try_divide(F.col("own") - F.col("v"), F.abs("v")) * 100)
    out = gain.groupBy(state, "metric").agg(F.avg("gain").alias("mean"), F.stddev("gain").alias("sd"), F.count("gain").alias("n"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n"))


def combine_dimensions(improvement: DataFrame, state: str) -> DataFrame:
    """Mean over metrics, errors in quadrature, 95 % interval."""
    out = improvement.groupBy(state).agg(F.avg("mean").alias("mean"), (F.sqrt(F.sum(F.col("se") ** 2)) / F.count("*")).alias("se"))
    return out.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})


def priority_rank(df: DataFrame, columns: list[str], threshold: float = 70.0) -> DataFrame:
    """``pr_<column>``: percentile rank, 100 for the best, ties averaged; ``label``: the columns at or above a threshold.

    Ranks come from counts per distinct value, summed along the values in ranges; no task sorts the table.
    """
    out = df
    for c in columns:
        values = df.groupBy(c).agg(F.count("*").alias("k_"))
        ranked = ranked_prefix(values, c, c, ["k_"], descending=False)
        n = values.agg(F.sum("k_").alias("n_"))
        pct = ((F.col("cum_k_") - (F.col("k_") - 1) / 2) / F.col("n_") * 100).alias(f"pr_{c}")
        out = out.join(ranked.crossJoin(F.broadcast(n)).select(c, pct), c)
    names = [F.when(F.col(f"pr_{c}") >= threshold, F.lit(c)) for c in columns]
    return out.withColumn("label", F.concat_ws("+", *names))


def pit(reference: DataFrame, pool: DataFrame, column: str) -> DataFrame:
    """``pool`` with ``pit``: the share of reference values that are not above the row's."""
    both = reference.select(F.col(column), F.lit(1).alias("ref_")).unionByName(pool.select(F.col(column), F.lit(0).alias("ref_")))
    values = stored(both.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("ref_").alias("r_")), "values")
    ranked = ranked_prefix(values, column, column, ["r_"], descending=False)
    n = values.agg(F.sum("r_").alias("n_"))
    share = ranked.crossJoin(F.broadcast(n)).select(column, F.try_divide("cum_r_", "n_").alias("pit"))
    return pool.join(stored(share, "share"), column, "left")


def kernel_weight(rank: Column, n: Column, kind: str = "decreasing", sigma: float = 0.15, scale: Column | None = None) -> Column:
    """Weight of position ``rank`` of ``n``: 1 - u, u, or a bell around one half, over n; u = (rank - 1/2) / n.

    The bell is scaled so that its weights add up to n / 2; ``scale`` is their sum before.
    """
    u = (rank - 0.5) / n
    if kind == "decreasing":
        return (1 - u) / n
    if kind == "increasing":
        return u / n
    return F.exp(-((u - 0.5) ** 2) / (2 * sigma**2)) / scale * n * 0.5


def with_kernel(df: DataFrame, kind: str, sigma: float = 0.15) -> DataFrame:
    """``df``, which has rank and n, with ``w``."""
    if kind != "gaussian":
        return df.withColumn("w", kernel_weight(F.col("rank"), F.col("n"), kind))
    bell = F.exp(-(((F.col("rank") - 0.5) / F.col("n") - 0.5) ** 2) / (2 * sigma**2))
    total = df.agg(F.sum(bell).alias("k_"))
    return df.crossJoin(F.broadcast(total)).withColumn("w", kernel_weight(F.col("rank"), F.col("n"), kind, sigma, F.col("k_"))).drop("k_")


def kernel_efficiency(df: DataFrame, order: str, values: list[str], key: str, kind: str = "decreasing") -> DataFrame:
    """Sum of values times the weights of their positions in descending order."""
    ranked = with_kernel(ranked_prefix(df, order, key, []), kind)
    return ranked.agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])


def policy_permutation(df: DataFrame, score: str, key: str, kind: str = "decreasing") -> DataFrame:
    """(key, position): the best score at the position of greatest weight, and so on.

    Weights fall from the first position, from the last, or from the middle; that order is taken in whole numbers, so
    that places equally far from the middle are ties (the lesser first) whatever their weights are rounded to.
    """
    ranked = ranked_prefix(df, score, key, [])
    far = {"decreasing": F.col("rank"), "increasing": -F.col("rank")}.get(kind, F.abs(2 * F.col("rank") - 1 - F.col("n")))
    places = ranked.select(F.col("rank").alias("position"), (-far).alias("near_"))
    heavy = ranked_prefix(places, "near_", "position", []).select("position", "rank")
    return ranked.select(key, score, "rank").join(heavy, "rank").select(key, score, "position")


def kernel_curve(df: DataFrame, score: str, value: str, key: str, kind: str) -> DataFrame:
    """Cumulative curve along the positions of :func:`policy_permutation`."""
    placed = policy_permutation(df, score, key, kind).drop(score).join(df, key)
    out = ranked_prefix(placed, "position", key, [value], descending=False)
    return out.select("position", (F.col("rank") / F.col("n") * 100).alias("pct"), F.col(f"cum_{value}").alias("cumulative"))


def topk(df: DataFrame, column: str, key: str, k: int, largest: bool = True) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.desc() if largest else c.asc(), key).limit(k)


def extremes(df: DataFrame, column: str, key: str) -> DataFrame:
    """Keys of the greatest and least values, the least key of ties."""
    return df.agg(F.max_by(key, F.struct(column, -F.col(key))).alias("argmax"), F.min_by(key, F.struct(column, key)).alias("argmin"))


def within_between(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Group means and deviations from them; means are aggregated and joined back."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"{c}_between") for c in columns])
    return df.join(means, group).withColumns({f"{c}_within": F.col(c) - F.col(f"{c}_between") for c in columns})


def policy_paths(df: DataFrame, key: str, policy: Column, value: str, names: list[str]) -> DataFrame:
    """Cumulative sums of each policy and of their total along descending total; missing policies count 0."""
    wide = df.groupBy(key).pivot("p_", names).agg(F.avg(value)) if "p_" in df.columns else df.withColumn("p_", policy).groupBy(key).pivot("p_", names).agg(F.avg(value))
    wide = wide.na.fill(0.0, names)
    wide = stored(wide.withColumn("total", sum((F.col(n) for n in names), F.lit(0.0))), "paths")  # means, ranked in several passes
    return ranked_prefix(wide, "total", key, [*names, "total"]).select(key, "rank", *[f"cum_{n}" for n in [*names, "total"]])
