"""Row-wise formulas and predicates of the grid tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import class_by, clip, least_strict, total
from .quantiles import quantiles

# Constants of the energy and carbon formulas.
EARTH_RADIUS_M = 6371000.0
PIXEL_DEG = 0.0083333
MODULE_EFFICIENCY = 0.17
SYSTEM_EFFICIENCY = 0.8
HOURS = 8760.0
GRID_G_PER_KWH = 352.0
CO2_TO_C = 0.27
USD_2010_TO_2020 = 1.2
DWCI = {"forest": 0.10, "agro": 0.02, "veg": 0.04}
PERENNIAL = ("Alfalfa", "Banana", "Citrus", "Cocoa", "Coffee", "Coconut", "Oil palm", "Rubber", "Sugarcane", "Tea")
# Land-cover codes by class 1 to 9.
LANDCOVER = {
    1: (10, 11, 12, 20, 30, 40),
    2: (50, 60, 61, 62, 70, 71, 72, 80, 81, 82, 90, 160, 170),
    3: (100, 110),
    4: (120, 121, 122),
    5: (130, 140, 150, 151, 152, 153),
    6: (180,),
    7: (190,),
    8: (200, 201, 202, 220),
    9: (210,),
}
RCP_OF = {"C1": "RCP2.6", "C2": "RCP2.6", "C3": "RCP2.6", "C4": "RCP4.5", "C5": "RCP6.0", "C6": "RCP8.5", "C7": "RCP8.5", "C8": "RCP8.5"}


def bbox_filter(df: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Rows inside a box, edges included."""
    return df.where(F.col("lon").between(*lon) & F.col("lat").between(*lat))


def pv_yield(df: DataFrame, efficiency: float = MODULE_EFFICIENCY, system: float = SYSTEM_EFFICIENCY, pixel_deg: float = PIXEL_DEG) -> DataFrame:
    """Photovoltaic output of a cell: rsds in MJ/m2/d, tas in tenths of a kelvin, wind in m/s."""
    side = EARTH_RADIUS_M * pixel_deg
    df = df.withColumn("irradiance", F.col("rsds") * 1e6 / 86400.0)
    cell = 4.3 + 0.943 * (F.col("tas") * 0.1 - 273.15) + 0.028 * F.col("irradiance") - 1.528 * F.col("wind")
    df = df.withColumn("pvpot", (1 - 0.005 * (cell - 25.0)) * F.col("irradiance") / 1000.0)
    df = df.withColumns(
        {
            "cell_m2": F.radians(F.lit(1.0)) * side * (F.radians(F.lit(1.0)) * side * F.cos(F.radians("lat"))),
            "kwh_m2": efficiency * F.col("pvpot") * system * HOURS,
        }
    )
    return df.withColumn("kwh_pixel", F.col("kwh_m2") * F.col("cell_m2"))


def emission_t(kwh: Column, g_per_kwh: float = GRID_G_PER_KWH) -> Column:
    """Tonnes of CO2 that grid power of that amount would emit."""
    return kwh * g_per_kwh / 1e6


def reclass_landcover(code: Column) -> Column:
    """Land-cover code to its class 1 to 9; other codes stay."""
    out = code
    for cls, codes in LANDCOVER.items():
        out = F.when(code.isin(*codes), F.lit(cls)).otherwise(out)
    return out


def active_mask(year: int, start: str = "start_year", duration: str = "duration", recultivated: str | None = "recultivated") -> Column:
    """Whether land is still abandoned in ``year``, or was recultivated (where that column is given)."""
    lasts = F.col(start) + F.col(duration) - 1 >= year
    return lasts if recultivated is None else lasts | (F.col(recultivated) == 1)


def policy_group(policy: Column, mode: str = "other") -> Column:
    """P1, P2 or P3 by substring, else Other (``other``) or P4 (``p4``); or the first P with a digit (``regex3``, ``regex4``)."""
    if mode.startswith("regex"):
        return F.regexp_extract(policy, f"P[{'123' if mode == 'regex3' else '1234'}]", 0)
    out = F.lit("Other" if mode == "other" else "P4")
    for p in ("P3", "P2", "P1"):
        out = F.when(F.contains(policy, F.lit(p)), p).otherwise(out)
    return out


def rcp_of_category(category: Column) -> Column:
    """Pathway of a scenario category, null for others."""
    return reduce(lambda out, kv: F.when(category == kv[0], kv[1]).otherwise(out), RCP_OF.items(), F.lit(None).cast("string"))


def crop_of_column(name: Column) -> Column:
    return F.split(name, "_")[0]


def yield_kg(value: Column, name: Column) -> Column:
    """Yield in kg per hectare; columns in units of 10 kg are scaled; null is 0."""
    return F.coalesce(F.when(F.contains(F.lower(name), F.lit("10kg_dw_ha")), value * 10).otherwise(value), F.lit(0.0))


def perennial_mask(df: DataFrame, keywords: tuple[str, ...] = PERENNIAL) -> Column:
    """Whether any column named for a perennial crop holds class 1 or 2."""
    flags = [F.coalesce(F.col(c).isin(1, 2), F.lit(False)) for c in df.columns if any(k.lower() in c.lower() for k in keywords)]
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def lncs_strategies(df: DataFrame, perennial: Column, years: int = 30) -> DataFrame:
    """Baseline, accrued, cap, final and increment of carbon per hectare for forest, agroforestry and vegetation.

    Reads agb, soc, pot_agb, pot_soc, pot_total, sequestration, soc_bau, soc_t0x, forest_rmf, shrub_rmf and
    grass_rmf (percent) and landcover. A null input gives a null result.
    """
    agb, soc = F.col("agb"), F.col("soc")
    forest, shrub, grass = (F.col(f"{x}_rmf") * 0.01 for x in ("forest", "shrub", "grass"))
    shrubby = F.col("landcover").isin(3, 4)
    perennial_bio = agb * (1 / (1 - forest) + DWCI["agro"])
    veg_bio = agb * F.when(shrubby, 1 / (1 - shrub) + DWCI["veg"]).otherwise(1 / (1 - grass) + DWCI["veg"])
    soc_grown = soc * F.pow(1 + (F.pow(F.col("soc_bau") / F.col("soc_t0x"), F.lit(1 / 20)) - 1), F.lit(years))
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "baseline_forest": agb + agb * forest / (1 - forest) + soc + agb * DWCI["forest"],
            "baseline_agro": soc + F.when(perennial, perennial_bio).otherwise(zero),
            "baseline_veg": soc + veg_bio,
            "acc_forest": F.col("sequestration") * years * (1 / (1 - forest) + DWCI["forest"]) + F.col("pot_soc"),
            "cap_forest": F.col("pot_total") + DWCI["forest"] * F.col("pot_agb"),
            "acc_agro": soc_grown + F.when(perennial, perennial_bio).otherwise(zero),
            "cap_agro": F.col("pot_soc") + F.when(perennial, F.col("pot_total") * (1 + DWCI["agro"])).otherwise(zero),
            "acc_veg": soc_grown + veg_bio,
            "cap_veg": F.col("pot_total"),
        }
    )
    df = df.withColumns({f"final_{s}": least_strict(F.col(f"acc_{s}"), F.col(f"cap_{s}")) for s in DWCI})
    return df.withColumns({f"increment_{s}": F.col(f"final_{s}") - F.col(f"baseline_{s}") for s in DWCI})


def class_weights(df: DataFrame, prefix: str = "d") -> DataFrame:
    """Shares of forest, agriculture and vegetation from the shares of classes 1 to 9."""
    d = {k: F.col(f"{prefix}{k}") for k in range(1, 10)}
    return df.withColumns(
        {"w_forest": d[2] + d[6], "w_agro": d[1] + d[5], "w_veg": total([d[k] for k in (3, 4, 7, 8, 9)])}
    )


def lncs_expect(finals: list[str], weights: list[str]) -> Column:
    """Expected carbon: final values by their shares."""
    return total([F.col(a) * F.col(b) for a, b in zip(finals, weights, strict=True)])


def net_benefit(density: Column, expected: Column) -> tuple[Column, Column]:
    """Difference and ratio of the energy's and the land's carbon; the ratio by zero is null."""
    return density - expected, F.try_divide(density, expected)


def best_strategy(columns: list[str], names: list[str]) -> tuple[Column, Column]:
    """Name and value of the greatest column; the first one wins ties; null if all are null."""
    top = F.greatest(*columns)
    name = reduce(lambda out, cn: F.when(F.col(cn[0]) == top, cn[1]).otherwise(out), reversed(list(zip(columns, names, strict=True))), F.lit(None).cast("string"))
    return name, top


def usd2010_to_2020(value: Column) -> Column:
    return value * USD_2010_TO_2020


def unit_2020(unit: Column) -> Column:
    return F.replace(unit, F.lit("2010"), F.lit("2020"))


def clip_upper_quantile(df: DataFrame, columns: list[str], q: float = 0.99) -> DataFrame:
    """Cap columns at their quantile, an exact one, that is joined as a single row."""
    caps = quantiles(df, {f"cap_{c}": F.col(c) for c in columns}, [q])
    capped = {c: F.least(F.col(c), F.col(f"cap_{c}")[0]) for c in columns}
    return df.crossJoin(F.broadcast(caps)).withColumns(capped).drop(*[f"cap_{c}" for c in columns])


def safe_log1p(x: Column, low: float = -1 + 1e-6) -> Column:
    """log(1 + x) with x cut off below; null and NaN stay missing."""
    return F.when(x.isNull() | F.isnan(x), None).otherwise(F.log1p(F.greatest(x, F.lit(low))))


def inf_to_null(x: Column) -> Column:
    return F.when(F.abs(x) == float("inf"), None).otherwise(x)


def capacity_kw(area_m2: Column) -> Column:
    return area_m2 * MODULE_EFFICIENCY


def power_per_ha(kwh_year: Column, area_m2: Column, years: int = 30) -> Column:
    return kwh_year * years / area_m2 * 1e4


def power_pixel(per_ha: Column, area_m2: Column) -> Column:
    return per_ha * area_m2 / 1e4


def normalise(df: DataFrame, column: str, how: str = "minmax", out: str = "scaled") -> DataFrame:
    """Min-max or z-score (population) form of a column over the whole table; 0 where there is no range."""
    stats = df.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"), F.avg(column).alias("mu_"), F.stddev_pop(column).alias("sd_"))
    low, range_ = (F.col("lo_"), F.col("hi_") - F.col("lo_")) if how == "minmax" else (F.col("mu_"), F.col("sd_"))
    scaled = F.when(range_ == 0, F.lit(0.0)).otherwise((F.col(column) - low) / range_)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled).drop("lo_", "hi_", "mu_", "sd_")


def bivariate_class(df: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """Quantile classes 0..k-1 of two columns and their joint code."""
    breaks = quantiles(df, {"qa_": F.col(a), "qb_": F.col(b)}, [i / k for i in range(1, k)])
    out = df.crossJoin(F.broadcast(breaks)).withColumns({"class_a": class_by(F.col(a), F.col("qa_")), "class_b": class_by(F.col(b), F.col("qb_"))})
    return out.withColumn("class_ab", F.col("class_a") * k + F.col("class_b")).drop("qa_", "qb_")


def clipped_ratio(value: Column, base: Column, power: float, low: float | None, high: float | None) -> Column:
    ratio = F.pow(value / base, F.lit(power))
    return ratio if low is None else clip(ratio, low, high)
