"""Yearly class sequences, interpolation and discounted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip
from .quantiles import quantiles

# Fixed values of the discounted sums.
RATE = 1.05
LIFE = 30
START = 2020
GJ_TO_KWH = 277.778
CROP_MARGIN = 0.20
CROP_INVESTMENT = 4340.0


def class_string(df: DataFrame, keys: list[str], year: str = "year", code: str = "code") -> DataFrame:
    """One string per cell: a digit for every year, 1 for crops, 7 for built-up land, 0 for all else."""
    digit = F.when(F.col(code).isin(1, 7), F.col(code).cast("string")).otherwise("0")
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), digit.alias("d")))), lambda x: x["d"]), "").alias("s"), F.min(year).alias("first_year"))


def detect_abandonment(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that begin with two crop years and whose crops were later left for five years or more.

    Of several such spells the last one counts: its start, duration, whether crops (two years) or building came
    later, and whether it lasts to the end. A cell has as many rows as years, so a string per cell is bounded.
    """
    s = class_string(df, keys)
    part = lambda g: F.regexp_extract("s", "^(.*11)(0{5,})(.*)$", g)
    out = s.where(F.col("s").startswith("11") & F.col("s").rlike("^(.*11)(0{5,})(.*)$"))
    return out.select(
        *keys,
        (F.col("first_year") + F.length(part(1))).alias("start_year"),
        F.length(part(2)).alias("duration"),
        part(3).contains("11").cast("int").alias("recultivated"),
        part(3).contains("7").cast("int").alias("built"),
        (F.length(part(3)) == 0).cast("int").alias("current"),
    )


def candidate_mask(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with five or more years that are not built-up, any crop, and a crop year followed by two that are not built-up."""
    w = Window.partitionBy(*keys).orderBy("year")
    free = F.col("code") != 7
    follow = (F.col("code") == 1) & F.coalesce(F.lead(free, 1).over(w) & F.lead(free, 2).over(w), F.lit(False))
    out = df.withColumn("f_", follow).groupBy(*keys).agg(F.count_if(free).alias("free"), F.bool_or(F.col("code") == 1).alias("crop"), F.bool_or("f_").alias("followed"))
    return out.withColumn("candidate", (F.col("free") >= 5) & F.col("crop") & F.col("followed"))


def landcover_at_year(series: DataFrame, events: DataFrame, keys: list[str], year: str = "start_year") -> DataFrame:
    """Class of the cell in the event's year."""
    at = series.select(*keys, F.col("year").alias(year), "code")
    return events.join(at, [*keys, year], "left")


def post_abandonment_class(series: DataFrame, events: DataFrame, keys: list[str], year: str = "start_year") -> DataFrame:
    """From the event's year on: crops (1) if two crop years follow each other, else the commonest class.

    Of classes that are equally common the one that reached that number first counts.
    """
    rows = series.join(events.select(*keys, year), keys).where(F.col("year") >= F.col(year))
    w = Window.partitionBy(*keys).orderBy("year")
    seen = Window.partitionBy(*keys, "code").orderBy("year")
    rows = rows.withColumns({"pair_": (F.col("code") == 1) & (F.lead("code").over(w) == 1), "k_": F.row_number().over(seen)})
    out = rows.groupBy(*keys).agg(F.bool_or("pair_").alias("pair_"), F.min_by("code", F.struct(-F.col("k_"), F.col("year"))).alias("code_"))
    return out.select(*keys, F.when(F.col("pair_"), 1).otherwise(F.col("code_")).alias("later_class"))


def interp_series(knots: DataFrame, keys: list[str], x: str, y: str, at: list[int], mode: str = "clamp") -> DataFrame:
    """(keys, x, y) at the given places: linear between knots, beyond them held (``clamp``) or continued (``extend``).

    Null knots are left out; a key without knots has no rows. Knots of one key are few and stay in one array.
    """
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ks = knots.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("k_"))
    rows = ks.withColumn(x, F.explode(F.array(*map(F.lit, at))))
    t = F.col(x).cast("double")
    n = F.size("k_")
    below = F.size(F.filter("k_", lambda k: k["x"] <= t))
    i = F.greatest(F.least(below, n - 1), F.lit(1))  # the segment between knots i and i + 1, from 1
    a, b = F.get("k_", i - 1), F.get("k_", i)
    line = a["y"] + (b["y"] - a["y"]) * (t - a["x"]) / (b["x"] - a["x"])
    first, last = F.get("k_", F.lit(0)), F.get("k_", n - 1)
    value = F.when(n == 1, first["y"])
    if mode == "clamp":
        value = value.when(t <= first["x"], first["y"]).when(t >= last["x"], last["y"])
    return rows.withColumn(y, value.otherwise(line)).drop("k_")


def interp_between_grids(a: DataFrame, b: DataFrame, keys: list[str], value: str, y0: int, y1: int, yt: int) -> DataFrame:
    """Cellwise linear interpolation between two years' grids."""
    w = (yt - y0) / (y1 - y0)
    right = b.select(*keys, F.col(value).alias("v1_"))
    return a.join(right, keys).select(*keys, (F.col(value) + (F.col("v1_") - F.col(value)) * w).alias(value))


def scenario_factors(yearly: DataFrame, keys: list[str], targets: list[int], price: str = "price", om: str = "om", ratio: str | None = None) -> DataFrame:
    """By scenario and target year the discounted sums of price per kWh (A) and of running cost (B) of all years up to it.

    They replace the years in every cell's sum: value = -capex + generation * A - capacity * B. ``ratio`` weights both.
    """
    d = F.pow(F.lit(RATE), F.col("year") - START)
    g = F.lit(1.0) if ratio is None else F.col(ratio)
    rows = yearly.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where("year > 2020 or year = 2020")
    inside = (F.col("year") > START) & (F.col("year") <= F.least(F.col("target"), F.lit(START + LIFE)))
    term = lambda c: F.sum(F.when(inside, F.col(c) * g / d).otherwise(0.0))
    return rows.groupBy(*keys, "target").agg((term(price) / GJ_TO_KWH).alias("a"), term(om).alias("b"))


def npv_pv(pixels: DataFrame, factors: DataFrame, capital: DataFrame, keys: list[str], generation: str = "kwh", area: str = "area_m2") -> DataFrame:
    """Value and cost per hectare of every cell, scenario and target year; factors are broadcast, years never exploded."""
    f = factors.join(capital, keys)
    kw, ha = F.col(area) * 0.17, F.col(area) / 1e4
    df = pixels.crossJoin(F.broadcast(f))
    return df.withColumns({"npv_ha": (F.col(generation) * F.col("a") - kw * (F.col("capex") + F.col("b"))) / ha, "cost_ha": kw * (F.col("capex") + F.col("b")) / ha})


def adjusted_factors(yearly: DataFrame, ratios: DataFrame, keys: list[str], region: str, targets: list[int]) -> DataFrame:
    """:func:`scenario_factors` of every region (a_adj, b_adj) with each year weighted by the region's ``ratio`` of that
    year, 1 where it has none. Regions are those of ``ratios`` (region, year, ratio); scenarios, years and regions are few."""
    every = yearly.crossJoin(ratios.select(region).where(F.col(region).isNotNull()).distinct())
    rated = every.join(ratios.select(region, "year", "ratio"), [region, "year"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    return scenario_factors(rated, [*keys, region], targets, ratio="ratio").withColumnsRenamed({"a": "a_adj", "b": "b_adj"})


def npv_pv_adjusted(pixels: DataFrame, factors: DataFrame, adjusted: DataFrame, capital: DataFrame, keys: list[str], region: str, generation: str = "kwh", area: str = "area_m2") -> DataFrame:
    """:func:`npv_pv` for every target year with ``npv_adj_ha``, in which demand ratios weight the yearly cash flows.

    Cells of a region without ratios, or of none, have the plain value there. The factors of a region, scenario and target
    are one small table, so the cells are read once and years are never exploded.
    """
    both = factors.join(adjusted, [*keys, "target"])
    known = adjusted.select(F.col(region).alias("r_")).distinct()
    plain = factors.withColumns({region: F.lit(None).cast(dict(adjusted.dtypes)[region]), "a_adj": F.col("a"), "b_adj": F.col("b")})
    table = both.unionByName(plain).join(capital, keys).withColumnRenamed(region, "r_")
    cells = pixels.join(known, pixels[region] == known["r_"], "left")
    kw, ha = F.col(area) * 0.17, F.col(area) / 1e4
    cells = cells.withColumnRenamed("r_", "own_")
    out = cells.join(table, F.col("own_").eqNullSafe(F.col("r_"))).drop("own_", "r_")
    value = lambda a, b: (F.col(generation) * F.col(a) - kw * (F.col("capex") + F.col(b))) / ha
    return out.withColumns({"npv_ha": value("a", "b"), "cost_ha": kw * (F.col("capex") + F.col("b")) / ha, "npv_adj_ha": value("a_adj", "b_adj")})


def total_of(values: Column) -> Column:
    """Sum of an array of doubles, 0 if it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def crop_revenues(yields: Column, prices: Column) -> Column:
    """Of an array of (crop, kg) and a map of arrays of prices by crop: the crops' (kg, r), r the revenue under each price."""
    met = lambda y: F.transform(F.try_element_at(prices, y["crop"]), lambda p: F.struct(y["kg"].alias("kg"), (y["kg"] * p / 1000).alias("r")))
    return F.flatten(F.filter(F.transform(yields, met), lambda x: x.isNotNull()))


def prices_by_crop(prices: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``p_``, a map of each crop's prices; null crops, which match none, are left out."""
    each = prices.groupBy(*by, "crop").agg(F.collect_list(F.struct("price")).alias("l_"))
    lists = F.collect_list(F.when(F.col("crop").isNotNull(), F.struct("crop", F.transform("l_", lambda x: x["price"]))))
    return each.groupBy(*by).agg(F.map_from_entries(lists).alias("p_"))


def npv_crop(yields: DataFrame, prices: DataFrame, key: str, targets: list[int], scenario: str | None = None) -> DataFrame:
    """Discounted margin of crops by cell, price scenario (a column of the prices, if named) and target year.

    ``yields`` has (key, crop, kg); ``prices`` has (crop, year, price) for every year. A year's revenue is the
    revenue-weighted mean of the crops' revenues, sum(r * r) / sum(r). Prices are a table of crops, scenarios and years.
    A cell's crops travel as one row; scenarios and years are met after that shuffle, inside the row.
    """
    by = [scenario] if scenario else []
    cells = yields.groupBy(key).agg(F.collect_list(F.when(F.col("kg") > 0, F.struct("crop", "kg"))).alias("y_"))
    asked = (F.col("price") > 0) & (F.col("year") > START) & (F.col("year") <= START + LIFE)
    yearly = prices_by_crop(prices.where(asked), [*by, "year"]).groupBy(*by).agg(F.collect_list(F.struct("year", "p_")).alias("s_"))
    series = prices.select(*by).distinct().join(yearly, by, "left") if by else yearly
    revenues = lambda s: F.transform(crop_revenues(F.col("y_"), s["p_"]), lambda x: x["r"])
    mean = lambda r: F.coalesce(F.try_divide(total_of(F.transform(r, lambda x: x * x)), total_of(r)), F.lit(0.0))
    gain = lambda s: mean(revenues(s)) * CROP_MARGIN / F.pow(F.lit(RATE), s["year"] - START)
    rows = cells.crossJoin(F.broadcast(series)).select(key, *by, F.transform(F.coalesce("s_", F.array()), lambda s: F.struct(s["year"].alias("year"), gain(s).alias("gain"))).alias("g_"))
    upto = lambda t: total_of(F.transform(F.filter("g_", lambda g: g["year"] <= t), lambda g: g["gain"]))
    long = rows.select(key, *by, F.inline(F.array(*[F.struct(F.lit(t).cast("int").alias("target"), upto(t).alias("gain")) for t in targets])))
    return long.select(key, *by, "target", (F.col("gain") - CROP_INVESTMENT).alias("npv_ha"))


def wood_omega(half_lives: dict[str, float], years: int = 30, delta: float = 0.05, bef: float = 1.3) -> float:
    """Share of carbon that wood products keep: decay by half-lives, discounted by (1 - delta) ** year."""
    disc = [(1 - delta) ** y for y in range(1, years + 1)]
    kept = sum(sum((2 ** (-y / h) if h else 1.0) * d for y, d in enumerate(disc, 1)) for h in half_lives.values())
    return kept / (bef * sum(disc))


def npv_forest(df: DataFrame, target: Column, omega: float, rho: float, years: int = LIFE) -> Column:
    """Cost now, and wood after 30 years if the target is that far: least(potential, growth) * omega * rho, discounted."""
    wood = F.least(F.col("pot_agb"), F.col("sequestration") * years) * omega * rho / RATE**30
    return -F.col("cost") + F.when(target - START >= 30, wood).otherwise(0.0)


def npv_natural(cost: Column) -> Column:
    return -cost


def net_expected_benefit(pv: DataFrame, alts: DataFrame, weights: DataFrame, key: str, year: str = "analysis_year") -> DataFrame:
    """Energy value less the weighted means over pathways of the three alternatives, by cell and year."""
    names = ("agri", "forest", "natural")
    means = alts.groupBy(key, year).agg(*[F.avg(f"npv_{n}").alias(n) for n in names])
    lost = sum((F.col(f"w_{n}") * F.col(n) for n in names), F.lit(0.0))
    return pv.join(means, [key, year]).join(weights, key).withColumn("net", F.col("npv_usd") - lost)


def demand_ratio(df: DataFrame, group: list[str], value: str, alpha: float = 0.3, clipped: bool = True) -> DataFrame:
    """(value / median of the group) ** alpha, cut to 0.7 to 1.3 on request."""
    med = quantiles(df, {"q_": F.col(value)}, [0.5], group).select(*group, F.col("q_")[0].alias("med_"))
    ratio = F.pow(F.try_divide(F.col(value), F.col("med_")), F.lit(alpha))
    return df.join(med, group).withColumn("ratio", clip(ratio, 0.7, 1.3) if clipped else ratio).drop("med_")


def crop_price_series(prices: DataFrame) -> DataFrame:
    """Dollars per tonne from value (millions) and amount (thousands of tonnes); nothing where the amount is not positive."""
    wide = prices.groupBy("item", "scenario", "year").pivot("element", ["value", "tonnes"]).agg(F.first("value"))
    return wide.where("tonnes > 0").select("item", "scenario", "year", (F.col("value") / F.col("tonnes") * 1000).alias("price"))
