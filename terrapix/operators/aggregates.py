"""Aggregations over cells, regions, scenarios and policies."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import class_by
from ..functions.distributions import t_critical
from ..sources.tables import stored
from .globe import with_sphere_cell
from .quantiles import quantiles
from .ranking import ranked_prefix


def group_mean(df: DataFrame, keys: list[str], column: str, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(column).alias(out))


def summary(df: DataFrame, keys: list[str], value: str, cost: str | None = None, viability: bool = False) -> DataFrame:
    """Sum, count, least, greatest and mean of a value, with the mean cost and the percentage of rows above zero on request."""
    more = ([F.avg(cost).alias("mean_cost")] if cost else []) + ([F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("share_")] if viability else [])
    out = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), *more)
    out = out.withColumn("mean", F.try_divide("total", "n"))
    return out.withColumn("viable_pct", F.col("share_") * 100).drop("share_") if viability else out


def summary_state(df: DataFrame, keys: list[str], value: str, cost: str | None = None) -> DataFrame:
    """What :func:`merge_states` needs of a batch: by keys the sum, number, least and greatest value, all rows and those
    above zero, and the cost's sum and number."""
    v = F.col(value)
    c = F.col(cost) if cost else F.lit(None).cast("double")
    states = {"total": F.sum(v), "n": F.count(v), "lowest": F.min(v), "highest": F.max(v), "rows": F.count(F.lit(1)), "above": F.count_if(v > 0), "cost": F.sum(c), "costs": F.count(c)}
    return df.groupBy(*keys).agg(*[x.alias(f"state_{n}") for n, x in states.items()])


def merge_states(states: DataFrame, keys: list[str], cost: bool = False, viability: bool = False) -> DataFrame:
    """The :func:`summary` of all batches from their states, in any order and any grouping of batches."""
    s = lambda n: F.col(f"state_{n}")
    more = ([F.try_divide(F.sum(s("cost")), F.sum(s("costs"))).alias("mean_cost")] if cost else []) + ([(F.try_divide(F.sum(s("above")), F.sum(s("rows"))) * 100).alias("viable_pct")] if viability else [])
    out = states.groupBy(*keys).agg(F.sum(s("total")).alias("total"), F.sum(s("n")).alias("n"), F.min(s("lowest")).alias("lowest"), F.max(s("highest")).alias("highest"), *more)
    return out.withColumn("mean", F.try_divide("total", "n"))


def write_state(df: DataFrame, path: str, batch: str, keys: list[str], value: str, cost: str | None = None) -> None:
    """Store the state of one batch under its id: a batch that is run again replaces its state, so it counts once.

    Batches write to partitions of their own and may run at the same time.
    """
    state = summary_state(df, keys, value, cost).withColumn("batch", F.lit(batch))
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_summary(spark: SparkSession, path: str, keys: list[str], cost: bool = False, viability: bool = False) -> DataFrame:
    """The summary over all batches stored under ``path``."""
    return merge_states(spark.read.parquet(path), keys, cost, viability)


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean over ``inner`` groups, then the mean, deviation and number of those by ``outer``."""
    return group_mean(df, list(dict.fromkeys([*outer, *inner])), value, "m_").groupBy(*outer).agg(F.avg("m_").alias("mean"), F.stddev("m_").alias("sd"), F.count("m_").alias("n"))


def area_weighted(df: DataFrame, region: str, metrics: list[str], area: str = "area_m2") -> DataFrame:
    """Hectares and area-weighted means by region. A null metric adds nothing above the line and its area below it."""
    ha = F.col(area) / 1e4
    return df.groupBy(region).agg(F.sum(ha).alias("hectares"), F.count("*").alias("cells"), *[(F.sum(F.col(m) * ha) / F.sum(ha)).alias(m) for m in metrics])


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def profit_totals(df: DataFrame, key: str, value: str, area: str = "area_m2") -> DataFrame:
    """Totals of a value per hectare, with the numbers of cells in profit, loss and at zero."""
    ha = F.col(area) / 1e4
    v = F.col(value)
    return df.groupBy(key).agg(F.sum(v * ha).alias("total"), F.sum(ha).alias("hectares"), F.count("*").alias("n"), (F.sum(v * ha) / F.sum(ha)).alias("per_ha"), (F.sum(v * ha) / 1e9).alias("billions"), F.count_if(v > 0).alias("profit"), F.count_if(v < 0).alias("loss"), F.count_if(v == 0).alias("zero"))


def decile_extremes(df: DataFrame, value: str, key: str) -> DataFrame:
    """Means of the lowest and of the highest tenth of the rows (at least one row each), by distributed ranks.

    The values are stored once, as ranks read them in several passes and sums of doubles may differ from pass to pass.
    """
    k = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    ranked = ranked_prefix(stored(df.select(*dict.fromkeys([key, value])), "extremes"), value, key, [], descending=False)
    return ranked.agg(F.avg(F.when(F.col("rank") <= k, F.col(value))).alias("lowest_mean"), F.avg(F.when(F.col("rank") > F.col("n") - k, F.col(value))).alias("highest_mean"), F.max(k).alias("k"))


def block_of(idx: str, factor: int) -> Column:
    return F.floor(F.col(idx) / factor).cast("long")


def coarsen(df: DataFrame, factor: int, value: str, how: str = "mean", rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Mean, sum or max over factor x factor blocks; blocks that the grid's edge cuts off are left out."""
    if rows is not None:
        df = df.where(F.col("lat_idx") < rows - rows % factor)
    if cols is not None:
        df = df.where(F.col("lon_idx") < cols - cols % factor)
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return df.groupBy(block_of("lat_idx", factor).alias("block_lat"), block_of("lon_idx", factor).alias("block_lon")).agg(f(value).alias(value), F.count(value).alias("n"))


def class_fractions(df: DataFrame, factor: int, column: str, classes: range = range(1, 10)) -> DataFrame:
    """Share of each class in the cells of a block."""
    share = lambda k: F.count_if(F.col(column) == k) / F.count(column)
    return df.groupBy(block_of("lat_idx", factor).alias("block_lat"), block_of("lon_idx", factor).alias("block_lon")).agg(*[share(k).alias(f"f{k}") for k in classes])


def _bin(x: Column, low: float, high: float, n: int) -> Column:
    """0..n-1 over [low, high], the last edge included; null outside."""
    k = F.floor((x - low) / ((high - low) / n)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(k, F.lit(n - 1)))


def rect_bin_mean(df: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, values: list[str], at_least: int = 2) -> DataFrame:
    """Centre, number and means in rectangular bins over (lon_lo, lon_hi, lat_lo, lat_hi), sparse bins left out."""
    x0, x1, y0, y1 = box
    keyed = df.withColumns({"bx": _bin(F.col("lon"), x0, x1, nx), "by": _bin(F.col("lat"), y0, y1, ny)}).where("bx is not null and by is not null")
    out = keyed.groupBy("bx", "by").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values]).where(F.col("n") >= at_least)
    return out.withColumns({"centre_lon": x0 + (F.col("bx") + 0.5) * ((x1 - x0) / nx), "centre_lat": y0 + (F.col("by") + 0.5) * ((y1 - y0) / ny)})


def hist2d(df: DataFrame, box: tuple[float, float, float, float], nx: int = 50, ny: int = 50) -> DataFrame:
    return rect_bin_mean(df, box, nx, ny, [], 1).select("bx", "by", "n")


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the pointy-top hexagon of circumradius ``size`` that holds a point."""
    q, r = (x * (3**0.5 / 3) - y / 3) / size, (y * (2 / 3)) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return (
        F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"),
        F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr).cast("long"),
    )


def hex_agg(df: DataFrame, size: float, mean: list[str], skewed: list[str], classes: list[str], q: float = 0.75, x: str = "lon", y: str = "lat") -> DataFrame:
    """By hexagon: means, a quantile of the positive values of skewed columns, and the commonest class (least of ties).

    A hexagon has as many cells as its area holds, whatever the table's size, so its values are ranked in one aggregate.
    """
    a, b = hex_cell(F.col(x), F.col(y), size)
    return df.withColumns({"q": a, "r": b}).groupBy("q", "r").agg(*_hex_values(mean, skewed, classes, q))


def _hex_values(mean: list[str], skewed: list[str], classes: list[str], q: float) -> list[Column]:
    most = [F.mode(c, True).alias(c) for c in classes]
    high = [F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(q)).alias(c) for c in skewed]
    return [F.count("*").alias("n"), *[F.avg(c).alias(c) for c in mean], *high, *most]


def sphere_hex_agg(df: DataFrame, level: int, mean: list[str], skewed: list[str], classes: list[str], q: float = 0.75, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Like :func:`hex_agg`, by hexagon of the sphere (``cell``, see :mod:`globe`); points without coordinates are left out."""
    rows = with_sphere_cell(df.select(lat, lon, *dict.fromkeys([*mean, *skewed, *classes])), level, "cell", lat, lon)
    return rows.where("cell is not null").groupBy("cell").agg(*_hex_values(mean, skewed, classes, q))


def lat_band_ci(df: DataFrame, value: str, step: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Mean and 2.5 % and 97.5 % quantiles by band of latitude."""
    keys = [*(by or []), "band"]
    rows = df.withColumn("band", F.floor(F.col("lat") / step) * step)
    out = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    ends = quantiles(rows, {"q_": F.col(value)}, [0.025, 0.975], keys)
    return out.join(ends, keys, "left").withColumns({"low": F.col("q_")[0], "high": F.col("q_")[1]}).select(*keys, "mean", "n", "low", "high")


def weighted_histogram(df: DataFrame, value: str, weight: str, n: int = 20) -> DataFrame:
    """Sum of weights in ``n`` equal bins between the 1st and 99th percentile; what lies outside is left out."""
    ends = quantiles(df, {"e_": F.col(value)}, [0.01, 0.99])
    x, low, width = F.col(value), F.col("e_")[0], (F.col("e_")[1] - F.col("e_")[0]) / n
    k = F.least(F.floor((x - low) / width), F.lit(n - 1)).cast("int")
    return df.crossJoin(F.broadcast(ends)).where((x >= low) & (x <= F.col("e_")[1])).groupBy(k.alias("bin")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def quantile_table(df: DataFrame, columns: list[str], qs: list[float]) -> DataFrame:
    """Exact quantiles, one row per column."""
    one = quantiles(df, {c: F.col(c) for c in columns}, qs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("q")) for c in columns]))
    return one.select(rows.alias("x")).select("x.name", *[F.col("x.q")[i].alias(f"q{round(q * 1000)}") for i, q in enumerate(qs)])


def pivot(df: DataFrame, keys: list[str], column: str, values: list, value: str, how: str = "sum") -> DataFrame:
    return df.groupBy(*keys).pivot(column, values).agg({"sum": F.sum, "mean": F.avg}[how](value))


def unpivot_positive(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form of wide columns, values above 0 only."""
    return df.unpivot(keys, columns, "name", "value").where("value > 0")


def energy_rollup(df: DataFrame, first: int = 2017, last: int = 2050) -> DataFrame:
    """Electricity by state, scenario, sector and year, and over all sectors, in one pass of grouping sets."""
    rows = df.where((F.col("final_energy") == "ELECTRICITY") & F.col("year").between(first, last))
    sets = [["state", "scenario", "sector", "year"], ["state", "scenario", "year"]]
    out = rows.groupingSets(sets, "state", "scenario", "sector", "year").agg(F.sum("mmbtu").alias("mmbtu"), F.grouping("sector").cast("int").alias("all_sectors"))
    return out.select("state", "scenario", "sector", "year", "all_sectors", "mmbtu")


def mean_scenario(df: DataFrame, keys: list[str], value: str, name: str = "MEAN SCENARIO") -> DataFrame:
    """``df`` and, as one more scenario, the mean over its scenarios."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias(value)).withColumn("scenario", F.lit(name))
    return df.select(*keys, "scenario", value).unionByName(mean.select(*keys, "scenario", value))


def crop_suitability(df: DataFrame, columns: list[str], area: str = "area_m2") -> DataFrame:
    """By crop: percentage of cells and kilohectares of class 1, class 2 and others."""
    long = df.select(area, *columns).unpivot([area], columns, "crop", "cls")
    kinds = {"one": F.col("cls") == 1, "two": F.col("cls") == 2, "other": ~F.coalesce(F.col("cls").isin(1, 2), F.lit(False))}
    aggs = [x for k, c in kinds.items() for x in ((F.count_if(c) / F.count("*") * 100).alias(f"pct_{k}"), (F.sum(F.when(c, F.col(area)).otherwise(0.0)) / 1e7).alias(f"kha_{k}"))]
    return long.groupBy("crop").agg(*aggs)


def perennial_cells(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Distinct cells with class 1 or 2 in any of the columns."""
    return df.unpivot([key], columns, "crop", "cls").where(F.col("cls").isin(1, 2)).select(key).distinct()


def waterfall(fact: DataFrame, alts: DataFrame, policy: Column, key: str = "pixel_id") -> DataFrame:
    """By policy and overall: mean over pixels of pixel-mean revenue (value and cost), cost, opportunity cost and net."""
    lost = alts.groupBy(key).agg((F.avg(F.col("w_agri") * F.col("npv_agri")) + F.avg(F.col("w_forest") * F.col("npv_forest")) + F.avg(F.col("w_natural") * F.col("npv_natural"))).alias("opp"))
    rows = fact.withColumn("policy", policy)

    def means(keys: list[str]) -> DataFrame:
        per = rows.groupBy(*keys, key).agg(F.avg(F.col("npv_usd") + F.col("cost_usd")).alias("rev"), F.avg("cost_usd").alias("cost"))
        out = per.join(lost, key).groupBy(*keys).agg(F.avg("rev").alias("revenue"), F.avg("cost").alias("cost"), F.avg("opp").alias("opportunity"))
        return out.withColumn("net", F.col("revenue") - F.col("cost") - F.col("opportunity"))

    columns = ["policy", "revenue", "cost", "opportunity", "net"]
    return means(["policy"]).select(*columns).unionByName(means([]).withColumn("policy", F.lit("Overall")).select(*columns))


def policy_path_stats(df: DataFrame, policy: Column, value: str, key: str = "pixel_id") -> DataFrame:
    """By policy over pixels: mean of pixel means with deviation, number and 95 % t interval, and the share of positive paths."""
    per = df.groupBy(policy.alias("policy"), key).agg(F.avg(value).alias("m_"), F.count("*").alias("paths_"), F.count_if(F.col(value) > 0).alias("good_"))
    out = per.groupBy("policy").agg(F.count("*").alias("pixels"), F.avg("m_").alias("mean"), F.stddev("m_").alias("sd"), F.min("m_").alias("lowest"), F.max("m_").alias("highest"), (F.sum("good_") / F.sum("paths_")).alias("positive"))
    half = t_critical(F.col("pixels") - 1) * F.col("sd") / F.sqrt("pixels")
    return out.withColumn("half_", half).withColumns({"low": F.col("mean") - F.col("half_"), "high": F.col("mean") + F.col("half_")}).drop("half_")


def policy_year_stats(df: DataFrame, policy: Column, value: str, key: str = "pixel_id", year: str = "analysis_year") -> DataFrame:
    """By policy and year over pixel means: mean, deviation, number and quartiles."""
    per = df.groupBy(policy.alias("policy"), year, key).agg(F.avg(value).alias("m_"))
    out = per.groupBy("policy", year).agg(F.avg("m_").alias("mean"), F.stddev("m_").alias("sd"), F.count("m_").alias("n"))
    out = out.join(quantiles(per, {"q_": F.col("m_")}, [0.25, 0.75], ["policy", year]), ["policy", year], "left")
    return out.withColumns({"q25": F.col("q_")[0], "q75": F.col("q_")[1]}).drop("q_")


def over_years_ci(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of year means with a normal 95 % interval over the years."""
    out = stats.groupBy(*keys).agg(F.avg("mean").alias("overall"), (F.stddev("mean") / F.sqrt(F.count("mean"))).alias("se"))
    return out.withColumns({"low": F.col("overall") - 1.96 * F.col("se"), "high": F.col("overall") + 1.96 * F.col("se")})


def duplicates_report(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_report(df: DataFrame) -> DataFrame:
    """Nulls by column, columns without any left out."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "name", "missing").where("missing > 0")


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinite and zero counts and the variance of each column, in one pass."""
    one = df.agg(*[F.struct(F.count_if(F.isnan(F.col(c).cast("double")) | F.col(c).isNull()).alias("nans"), F.count_if(F.abs(c) == float("inf")).alias("infs"), F.count_if(F.col(c) == 0).alias("zeros"), F.var_pop(c).alias("variance")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("s")) for c in columns]))
    return one.select(rows.alias("x")).select("x.name", "x.s.*")


def condition_number(df: DataFrame, columns: list[str]) -> float:
    """Of the covariance matrix (n - 1, 1e-12 added along the diagonal); d x d sums come to the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    m = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row, strict=True):
        m[i, j] = m[j, i] = np.nan if v is None else v
    w = np.clip(np.linalg.eigvalsh(m + np.eye(len(m)) * 1e-12), 0.0, None) if np.isfinite(m).all() else np.array([np.nan])
    return float(w.max() / (w.min() + 1e-18))


def quality_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row over all columns: rows, missing, infinite and zero values, the range of variances, numbers of columns
    of no (up to 1e-12) and of low variance (up to 1e-4), and the condition number of the covariances."""
    stats = quality_report(df, columns)
    out = stats.agg(F.sum("nans").alias("nans"), F.sum("infs").alias("infs"), F.sum("zeros").alias("zeros"), F.min("variance").alias("least_variance"), F.max("variance").alias("greatest_variance"), F.count_if(F.col("variance") <= 1e-12).alias("no_variance"), F.count_if(F.col("variance") <= 1e-4).alias("low_variance"))
    return out.withColumns({"n_rows": F.lit(df.count()), "condition": F.lit(condition_number(df, columns))})


def describe_shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, quartiles, outliers beyond 1.5 IQR and 2.5 deviations, and a recommended transform of each column.

    Skewness and excess kurtosis are those of the population. Recommended: none up to a skewness of 0.5; square
    root up to 1 and log beyond for a right tail, square for a left one.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v")
    stats = long.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("sd"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"))
    found = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    quarters = found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("q")) for c in columns]))).where("q is not null")
    stats = stats.join(F.broadcast(quarters), "name")
    iqr = F.col("q")[2] - F.col("q")[0]
    out = long.join(F.broadcast(stats), "name").groupBy("name").agg(
        F.count_if((F.col("v") < F.col("q")[0] - 1.5 * iqr) | (F.col("v") > F.col("q")[2] + 1.5 * iqr)).alias("iqr_outliers"),
        F.count_if(F.abs(F.col("v") - F.col("mean")) > 2.5 * F.col("sd")).alias("z_outliers"),
    )
    skew = F.col("skew")
    advice = F.when(F.abs(skew) <= 0.5, "none").when(skew > 1, "log").when(skew > 0.5, "sqrt").otherwise("square")
    return stats.join(F.broadcast(out), "name").select("name", "n", "mean", "sd", "skew", "kurt", F.col("q")[1].alias("median"), "iqr_outliers", "z_outliers", advice.alias("advice"))


def class_by_nonzero_quantile(df: DataFrame, column: str, qs: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Class 0 for zero (and null), else 1 and up by quantiles of the values that are not zero."""
    nonzero = F.when(F.col(column) != 0, F.col(column))
    breaks = quantiles(df, {"b_": nonzero}, list(qs))
    cls = F.when(F.coalesce(F.col(column), F.lit(0)) == 0, 0).otherwise(class_by(F.col(column), F.col("b_"), 1))
    return df.crossJoin(F.broadcast(breaks)).withColumn("cls", cls.cast("int")).drop("b_")


def quantile_groups(df: DataFrame, column: str, k: int = 10, out: str = "grp", cuts: tuple[int, int] = (3, 7)) -> DataFrame:
    """Quantile class of a column collapsed to Low, Mid and High; the lowest class includes its edge."""
    breaks = quantiles(df, {"b_": F.col(column)}, [i / k for i in range(1, k)])
    cls = class_by(F.col(column), F.col("b_"))
    name = F.when(cls < cuts[0], "Low").when(cls < cuts[1], "Mid").when(cls.isNotNull(), "High")
    return df.crossJoin(F.broadcast(breaks)).withColumn(out, name).drop("b_")


def mean_sd_table(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v")
    return long.groupBy("name").agg(F.avg("v").alias("mean"), F.stddev("v").alias("sd"))


def national_totals(df: DataFrame, density: str, area: str = "area_m2") -> DataFrame:
    """Sum of density times hectares in Gt of carbon and of CO2, and the standard error of the density."""
    ha = F.col(area) / 1e4
    return df.agg((F.sum(F.col(density) * ha) / 1e9).alias("gt_c"), (F.sum(F.col(density) * ha) * 3.667 / 1e9).alias("gt_co2"), (F.stddev(density) / F.sqrt(F.count(density))).alias("se"))


def component_stats(df: DataFrame, posterior: str) -> DataFrame:
    """Mean posterior and number of rows dominated, by component of an array of probabilities (first of ties)."""
    top = F.array_position(F.col(posterior), F.array_max(posterior)) - 1
    rows = df.select(F.posexplode(posterior).alias("component", "p"), top.alias("top"))
    return rows.groupBy("component").agg(F.avg("p").alias("mean_p"), F.count_if(F.col("top") == F.col("component")).alias("dominant"))


def cluster_stats(df: DataFrame, posterior: str, clusters: dict[int, list[int]]) -> DataFrame:
    """By cluster of components: the mean of the summed posteriors, and rows whose greatest component is in it, in one pass."""
    top = F.array_position(F.col(posterior), F.array_max(posterior)) - 1
    total = lambda own: F.avg(reduce(lambda a, b: a + b, [F.get(posterior, F.lit(k)) for k in own]))
    one = df.agg(*[F.struct(F.lit(c).alias("cluster"), total(own).alias("mean_p"), F.count_if(top.isin(own)).alias("dominant")).alias(f"c{c}") for c, own in clusters.items()])
    return one.select(F.explode(F.array(*[f"c{c}" for c in clusters])).alias("x")).select("x.*")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
