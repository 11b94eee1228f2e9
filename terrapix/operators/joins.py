"""Joins of cell tables and of scenario tables, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_rows

GATHERED = 256
"""Rows of a cell that :func:`join_gathered` puts into one row at most."""


def join_cells(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Fold of equi joins on cell keys; of columns that several tables have, the first stays."""

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.drop(*[c for c in b.columns if c in a.columns and c not in keys]), keys, how)

    return reduce(step, frames)


def join_gathered(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of an inner :func:`join_cells`, for tables with many rows a cell, whose result is far larger than they are.

    The last table's rows of a cell are gathered into arrays of up to ``GATHERED`` rows, so that the last join meets few
    rows and the result's rows come from a loop over an array. Partitions are not coalesced by the size of what is
    shuffled, as it tells nothing of the result's.
    """
    spark = frames[0].sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    *first, last = [df.repartition(parts, *keys) for df in frames]
    rows = join_cells(first, keys)
    more = [c for c in last.columns if c not in rows.columns]
    if not more:
        return join_cells([rows, last], keys)
    part = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) - 1) / GATHERED)
    lists = last.withColumn("part_", part).groupBy(*keys, "part_").agg(F.collect_list(F.struct(*more)).alias("rows_"))
    met = rows.join(lists.select(*keys, *[F.col("rows_")[c].alias(c) for c in more]), keys)
    kept = [c for c in met.columns if c not in more]
    return met.select(*kept, *more, F.posexplode(more[0]).alias("at_", "x_")).select(*kept, *[F.get(c, F.col("at_")).alias(c) for c in more])


def outer_cells(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return join_cells(frames, keys, "full")


def left_enrich(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left")


def anti_cells(pool: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return pool.join(known.select(*keys), keys, "left_anti")


def semi_axis(grid: DataFrame, points: DataFrame, axes: list[str]) -> DataFrame:
    """Grid rows whose every axis value occurs among the points, each axis by itself."""
    return reduce(lambda g, a: g.join(points.select(a).distinct(), a, "left_semi"), axes, grid)


def scenario_cross(*sides: DataFrame) -> DataFrame:
    """Product of a table with small parameter tables."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), sides)


def common_scenarios(df: DataFrame, region: str, ids: list[str], meta: DataFrame) -> DataFrame:
    """Scenarios that every region has and the metadata know, with the latter's columns."""
    n = df.select(region).distinct().agg(F.count("*").alias("all_"))
    have = df.groupBy(*ids).agg(F.countDistinct(region).alias("n_"))
    return have.crossJoin(F.broadcast(n)).where("n_ = all_").select(*ids).join(meta, ids)


def availability(df: DataFrame, ids: list[str], years: int = 4) -> DataFrame:
    """Scenarios whose price and capital have a value in all years; ``om`` tells whether the running cost has."""
    full = lambda v: (F.count(F.when(F.col("variable") == v, F.col("value"))) >= years).alias(v)
    out = df.groupBy(*ids).agg(full("price"), full("capital"), full("om"))
    return out.where("price and capital").withColumn("pattern", F.when(F.col("om"), "complete").otherwise("no_om")).select(*ids, "om", "pattern")


def fill_om_regional_mean(df: DataFrame, ids: list[str], region: str, default: float = 50.0) -> DataFrame:
    """Running costs by scenario and year; scenarios without a complete series get the region's means, else a default."""
    om = df.where("variable = 'om'")
    means = om.groupBy(region, "analysis_year").agg(F.avg("value").alias("mean_"))
    whole = om.groupBy(*ids).agg((F.count("value") == F.count("*")).alias("whole_"))
    rows = om.join(whole, ids).join(means, [region, "analysis_year"], "left")
    filled = F.when(F.col("whole_"), F.col("value")).otherwise(F.coalesce("mean_", F.lit(default)))
    source = F.when(F.col("whole_"), "own").when(F.col("mean_").isNotNull(), "regional_mean").otherwise("default")
    return rows.select(*dict.fromkeys([*ids, region]), "analysis_year", filled.alias("om"), source.alias("source"))


def map_state_ratio(df: DataFrame, ratios: DataFrame, state: str, scenarios: list[str]) -> DataFrame:
    """One ratio column per scenario by state; 1 where the state has none."""
    wide = ratios.groupBy(state).pivot("scenario", scenarios).agg(F.first("ratio"))
    return df.join(wide, state, "left").na.fill(1.0, scenarios)


def crop_lookup(production: DataFrame, prices: DataFrame, mapping: Column) -> DataFrame:
    """Production rows with the price item of their crop; the mapping of crop names to items is distinct."""
    items = prices.select("item").distinct()
    names = production.select("crop").distinct().withColumn("item", mapping).join(items, "item")
    return production.join(F.broadcast(names), "crop")


def two_step_map(df: DataFrame, column: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """A key's zone, and that zone's merged zone."""
    return df.join(first, column, "left").join(second, "zone", "left")


def alignment_check(df: DataFrame, name: str, keys: list[str], reference: str) -> DataFrame:
    """By variable: cells, ranges of the coordinates, and whether they are those of the reference variable."""
    a, b = keys
    mark = F.xxhash64(a, b)
    stats = df.groupBy(name).agg(F.count("*").alias("cells"), F.min(a).alias("lo_a"), F.max(a).alias("hi_a"), F.min(b).alias("lo_b"), F.max(b).alias("hi_b"), F.bit_xor(mark).alias("x_"), F.sum(mark.cast("decimal(38,0)")).alias("y_"))
    ref = stats.where(F.col(name) == reference).select(*[F.col(c).alias(f"r_{c}") for c in stats.columns if c != name])
    same = reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"r_{c}")), [c for c in stats.columns if c != name], F.lit(True))
    return stats.crossJoin(F.broadcast(ref)).select(name, "cells", "lo_a", "hi_a", "lo_b", "hi_b", same.alias("aligned"))


def union_missing(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows by the order of a seeded hash: the same ones every time."""
    return first_rows(df.withColumn("h_", F.xxhash64(F.lit(seed), key)), n, "h_", key).drop("h_")


def remaining_pool(pool: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Pool rows that were not chosen."""
    return pool.join(chosen.select(*keys), keys, "left_anti")
