"""Queries of the row-wise formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r4
from ..operators import scalar as S
from .registry import query

ALIAS = "pixel_id"

CARBON = """
    SELECT pixel_id, landcover, CAST(20 + pixel_id % 50 AS DOUBLE) AS agb, CAST(40 + pixel_id % 30 AS DOUBLE) AS soc,
           CAST(60 + pixel_id % 70 AS DOUBLE) AS pot_agb, CAST(50 + pixel_id % 35 AS DOUBLE) AS pot_soc,
           CAST(130 + pixel_id % 90 AS DOUBLE) AS pot_total, CAST(pixel_id % 40 AS DOUBLE) / 1e1 AS sequestration,
           CAST(50 + pixel_id % 7 AS DOUBLE) AS soc_bau, CASE WHEN pixel_id % 50 = 0 THEN NULL ELSE CAST(49 + pixel_id % 5 AS DOUBLE) END AS soc_t0x,
           CAST(20 + pixel_id % 9 AS DOUBLE) AS forest_rmf, CAST(30 + pixel_id % 9 AS DOUBLE) AS shrub_rmf,
           CAST(60 + pixel_id % 9 AS DOUBLE) AS grass_rmf, pixel_id % 4 AS tea_class, pixel_id % 6 AS oil_palm_class
    FROM pixels"""

SHARES = "SELECT pixel_id, " + ", ".join(f"CAST((pixel_id * {7 + 2 * k}) % {20 + k} AS DOUBLE) / 2e2 AS d{k}" for k in range(1, 10)) + " FROM pixels"


def _sql(t, text):
    return t.spark.sql(text.replace("FROM pixels", "FROM {pixels}"), pixels=t.pixels)


@query("b1_bbox_filter", "pixels", "SELECT pixel_id, lat_idx, lon_idx FROM pixels WHERE lon BETWEEN -110e0 AND -90e0 AND lat BETWEEN 30e0 AND 42.5e0")
def b1(t):
    return S.bbox_filter(t.pixels, (-110.0, -90.0), (30.0, 42.5)).select("pixel_id", "lat_idx", "lon_idx")


YIELD = """
    SELECT *, 0.17e0 * pvpot * 0.8e0 * 8760e0 AS kwh_m2,
           (6371000e0 * radians(0.0083333e0)) * (6371000e0 * radians(0.0083333e0) * cos(radians(lat))) AS cell_m2
    FROM (SELECT *, (1 - 0.005e0 * (4.3e0 + 0.943e0 * (tas * 0.1e0 - 273.15e0) + 0.028e0 * irradiance - 1.528e0 * wind - 25e0)) * irradiance / 1000e0 AS pvpot
          FROM (SELECT *, rsds * 1e6 / 86400e0 AS irradiance FROM pixels) i) j"""


@query("b2_pv_yield", "pixels", f"SELECT pixel_id, round(pvpot, 4) AS pvpot, round(kwh_m2, 4) AS kwh_m2, round(kwh_m2 * cell_m2, 2) AS kwh_pixel FROM ({YIELD}) y")
def b2(t):
    return S.pv_yield(t.pixels).select("pixel_id", r4("pvpot"), r4("kwh_m2"), r4("kwh_pixel", 2)).toDF("pixel_id", "pvpot", "kwh_m2", "kwh_pixel")


@query("b3_emission", "pixels", f"SELECT pixel_id, round(kwh_m2 * area_m2 * 352e0 / 1e6, 4) AS t_co2 FROM ({YIELD}) y")
def b3(t):
    return S.pv_yield(t.pixels).select("pixel_id", r4(S.emission_t(F.col("kwh_m2") * F.col("area_m2"))).alias("t_co2"))


@query(
    "b4_reclass_landcover",
    "pixels",
    """SELECT code, CAST(CASE WHEN code IN (10, 11, 12, 20, 30, 40) THEN 1 WHEN code IN (50, 60, 61, 62, 70, 71, 72, 80, 81, 82, 90, 160, 170) THEN 2
       WHEN code IN (100, 110) THEN 3 WHEN code IN (120, 121, 122) THEN 4 WHEN code IN (130, 140, 150, 151, 152, 153) THEN 5 WHEN code = 180 THEN 6
       WHEN code = 190 THEN 7 WHEN code IN (200, 201, 202, 220) THEN 8 WHEN code = 210 THEN 9 ELSE code END AS BIGINT) AS class, count(*) AS n
       FROM (SELECT CASE WHEN pixel_id % 3 = 0 THEN 10 * (pixel_id % 24) ELSE pixel_id % 230 END AS code FROM pixels) c GROUP BY 1, 2""",
)
def b4(t):
    code = F.when(F.col("pixel_id") % 3 == 0, 10 * (F.col("pixel_id") % 24)).otherwise(F.col("pixel_id") % 230)
    return t.pixels.select(code.alias("code")).groupBy("code", S.reclass_landcover(F.col("code")).cast("long").alias("class")).agg(F.count("*").alias("n"))


SPELL = "SELECT pixel_id, 1995 + pixel_id % 20 AS start_year, 5 + pixel_id % 17 AS duration, CAST(pixel_id % 8 = 0 AS INT) AS recultivated FROM pixels"


@query(
    "b5_active_mask",
    "pixels",
    f"""SELECT pixel_id, start_year + duration - 1 >= 2020 OR recultivated = 1 AS active, start_year + duration - 1 >= 2020 AS strict FROM ({SPELL}) s""",
)
def b5(t):
    return _sql(t, SPELL).select("pixel_id", S.active_mask(2020).alias("active"), S.active_mask(2020, recultivated=None).alias("strict"))


@query(
    "b6_policy_group",
    "npv",
    """SELECT policy_category, CASE WHEN contains(policy_category, 'P1') THEN 'P1' WHEN contains(policy_category, 'P2') THEN 'P2'
       WHEN contains(policy_category, 'P3') THEN 'P3' ELSE 'Other' END AS grp, regexp_extract(policy_category, 'P[123]', 0) AS rx, count(*) AS n FROM npv GROUP BY 1, 2, 3""",
)
def b6(t):
    p = F.col("policy_category")
    return t.npv.groupBy(p, S.policy_group(p).alias("grp"), S.policy_group(p, "regex3").alias("rx")).agg(F.count("*").alias("n"))


RCP_CASE = """CASE WHEN category IN ('C1', 'C2', 'C3') THEN 'RCP2.6' WHEN category = 'C4' THEN 'RCP4.5' WHEN category = 'C5' THEN 'RCP6.0'
    WHEN category IN ('C6', 'C7', 'C8') THEN 'RCP8.5' END"""


@query("b7_rcp_of_category", "npv", f"SELECT category, {RCP_CASE} AS rcp, count(*) AS n FROM npv GROUP BY 1, 2")
def b7(t):
    return t.npv.groupBy("category", S.rcp_of_category(F.col("category")).alias("rcp")).agg(F.count("*").alias("n"))


@query(
    "b8_yield_kg",
    "crops",
    """SELECT pixel_id, split_part(name, '_', 1) AS crop, coalesce(CASE WHEN contains(name, '10kg_dw_ha') THEN v * 10 ELSE v END, 0e0) AS kg_ha
       FROM (SELECT pixel_id, 'maize_rcp26_kg_dw_ha' AS name, maize_rcp26_kg_dw_ha AS v FROM crops UNION ALL
             SELECT pixel_id, 'wheat_rcp26_10kg_dw_ha', wheat_rcp26_10kg_dw_ha FROM crops UNION ALL
             SELECT pixel_id, 'soybean_rcp26_kg_dw_ha', soybean_rcp26_kg_dw_ha FROM crops) u""",
)
def b8(t):
    names = [c for c in t.crops.columns if c.endswith("dw_ha")]
    long = t.crops.unpivot("pixel_id", names, "name", "v")
    return long.select("pixel_id", S.crop_of_column(F.col("name")).alias("crop"), S.yield_kg(F.col("v"), F.col("name")).alias("kg_ha"))


@query("b9_perennial_mask", "pixels", f"SELECT pixel_id, tea_class IN (1, 2) OR oil_palm_class IN (1, 2) AS perennial FROM ({CARBON}) c")
def b9(t):
    df = _sql(t, CARBON)
    return df.select("pixel_id", S.perennial_mask(df, ("tea", "oil_palm")).alias("perennial"))


LNCS = f"""
    SELECT *, CASE WHEN acc_f IS NULL THEN NULL ELSE least(acc_f, cap_f) END AS fin_f, CASE WHEN acc_a IS NULL THEN NULL ELSE least(acc_a, cap_a) END AS fin_a,
           CASE WHEN acc_v IS NULL THEN NULL ELSE least(acc_v, cap_v) END AS fin_v
    FROM (SELECT *, sequestration * 30 * (1 / (1 - fr) + 0.1e0) + pot_soc AS acc_f, pot_total + 0.1e0 * pot_agb AS cap_f,
                 grown + CASE WHEN per THEN agb * (1 / (1 - fr) + 0.02e0) ELSE 0e0 END AS acc_a,
                 pot_soc + CASE WHEN per THEN pot_total * 1.02e0 ELSE 0e0 END AS cap_a, grown + vb AS acc_v, pot_total AS cap_v,
                 agb + agb * fr / (1 - fr) + soc + agb * 0.1e0 AS base_f, soc + CASE WHEN per THEN agb * (1 / (1 - fr) + 0.02e0) ELSE 0e0 END AS base_a, soc + vb AS base_v
          FROM (SELECT *, soc * pow(1 + (pow(soc_bau / soc_t0x, 0.05e0) - 1), 30) AS grown,
                       agb * CASE WHEN landcover IN (3, 4) THEN 1 / (1 - shrub_rmf * 0.01e0) + 0.04e0 ELSE 1 / (1 - grass_rmf * 0.01e0) + 0.04e0 END AS vb
                FROM (SELECT *, forest_rmf * 0.01e0 AS fr, tea_class IN (1, 2) OR oil_palm_class IN (1, 2) AS per FROM ({CARBON}) c) a) b) d"""


def _lncs(t):
    df = _sql(t, CARBON)
    return S.lncs_strategies(df, S.perennial_mask(df, ("tea", "oil_palm")))


@query(
    "b10_lncs_strategies",
    "pixels",
    "SELECT pixel_id, "
    + ", ".join(f"round(fin_{a}, 4) AS final_{n}, round(fin_{a} - base_{a}, 4) AS increment_{n}" for a, n in (("f", "forest"), ("a", "agro"), ("v", "veg")))
    + f" FROM ({LNCS}) l",
)
def b10(t):
    return _lncs(t).select("pixel_id", *[r4(f"{k}_{s}").alias(f"{k}_{s}") for s in ("forest", "agro", "veg") for k in ("final", "increment")])


@query(
    "b11_class_weights",
    "pixels",
    f"SELECT pixel_id, round(d2 + d6, 4) AS w_forest, round(d1 + d5, 4) AS w_agro, round(d3 + d4 + d7 + d8 + d9, 4) AS w_veg FROM ({SHARES}) s",
)
def b11(t):
    return S.class_weights(_sql(t, SHARES)).select("pixel_id", *[r4(c).alias(c) for c in ("w_forest", "w_agro", "w_veg")])


EXPECT = f"""SELECT l.pixel_id, fin_f * (d2 + d6) + fin_a * (d1 + d5) + fin_v * (d3 + d4 + d7 + d8 + d9) AS e, fin_f, fin_a, fin_v
    FROM ({LNCS}) l JOIN ({SHARES}) s ON l.pixel_id = s.pixel_id"""


def _expect(t):
    df = _lncs(t).join(S.class_weights(_sql(t, SHARES)), "pixel_id")
    return df.withColumn("e", S.lncs_expect(["final_forest", "final_agro", "final_veg"], ["w_forest", "w_agro", "w_veg"]))


@query("b12_net_benefit", "pixels", f"SELECT pixel_id, round(pixel_id % 90 - e, 4) AS net, round(CASE WHEN e <> 0 THEN pixel_id % 90 / e END, 4) AS ratio FROM ({EXPECT}) x")
def b12(t):
    net, ratio = S.net_benefit((F.col("pixel_id") % 90).cast("double"), F.col("e"))
    return _expect(t).select("pixel_id", r4(net).alias("net"), r4(ratio).alias("ratio"))


@query(
    "b13_best_strategy",
    "pixels",
    f"""SELECT pixel_id, CASE WHEN fin_f = top THEN 'forest' WHEN fin_a = top THEN 'agro' WHEN fin_v = top THEN 'veg' END AS best, round(top, 4) AS top
        FROM (SELECT *, greatest(fin_f, fin_a, fin_v) AS top FROM ({LNCS}) l) g""",
)
def b13(t):
    name, top = S.best_strategy(["final_forest", "final_agro", "final_veg"], ["forest", "agro", "veg"])
    return _lncs(t).select("pixel_id", name.alias("best"), r4(top).alias("top"))


@query("b14_usd2010_to_2020", "scen_long", "SELECT model, scenario, variable, analysis_year, round(value * 1.2e0, 4) AS usd, replace('US$2010/GJ', '2010', '2020') AS unit FROM scen_long")
def b14(t):
    return t.scen_long.select("model", "scenario", "variable", "analysis_year", r4(S.usd2010_to_2020(F.col("value"))).alias("usd"), S.unit_2020(F.lit("US$2010/GJ")).alias("unit"))


@query(
    "b16_clip_upper_quantile",
    "pixels",
    "SELECT pixel_id, round(least(npv, q), 4) AS npv FROM pixels, (SELECT quantile_cont(npv, 0.99) AS q FROM pixels) z",
)
def b16(t):
    return S.clip_upper_quantile(t.pixels, ["npv"]).select("pixel_id", r4("npv").alias("npv"))


@query(
    "b17_safe_log1p",
    "pixels",
    "SELECT pixel_id, round(ln(1 + greatest(carbon, -1 + 1e-6)), 4) AS lg, round(CASE WHEN pixel_id % 10 = 0 THEN NULL ELSE 1e1 / (pixel_id % 10) END, 4) AS finite FROM pixels",
)
def b17(t):
    ratio = F.when(F.col("pixel_id") % 10 == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(10.0), F.col("pixel_id") % 10))
    return t.pixels.select("pixel_id", r4(S.safe_log1p(F.col("carbon"))).alias("lg"), r4(S.inf_to_null(ratio)).alias("finite"))


@query("b18_capacity_kw", "pixels", "SELECT pixel_id, round(area_m2 * 0.17e0, 4) AS kw, round(area_m2 * 0.17e0 / 1e6, 8) AS gw FROM pixels")
def b18(t):
    kw = S.capacity_kw(F.col("area_m2"))
    return t.pixels.select("pixel_id", r4(kw).alias("kw"), r4(kw / 1e6, 8).alias("gw"))


@query("b19_lncs_expect", "pixels", f"SELECT pixel_id, round(e, 6) AS expected FROM ({EXPECT}) x")
def b19(t):
    return _expect(t).select("pixel_id", r4("e", 6).alias("expected"))


@query("b20_power_per_ha", "pixels", f"SELECT pixel_id, round(kwh_m2 * area_m2 * 30 / area_m2 * 1e4, 0) AS per_ha, round(kwh_m2 * area_m2 * 30, 1) AS pixel_kwh FROM ({YIELD}) y")
def b20(t):
    df = S.pv_yield(t.pixels).withColumn("per_ha", S.power_per_ha(F.col("kwh_m2") * F.col("area_m2"), F.col("area_m2")))
    return df.select("pixel_id", r4("per_ha", 0).alias("per_ha"), r4(S.power_pixel(F.col("per_ha"), F.col("area_m2")), 1).alias("pixel_kwh"))


@query(
    "b21_normalise",
    "pixels",
    """SELECT pixel_id, round((npv - lo) / (hi - lo), 6) AS mm, round((npv - mu) / sd, 6) AS z
       FROM pixels, (SELECT min(npv) AS lo, max(npv) AS hi, avg(npv) AS mu, stddev_pop(npv) AS sd FROM pixels) s""",
)
def b21(t):
    df = S.normalise(S.normalise(t.pixels, "npv", "minmax", "mm"), "npv", "zscore", "z")
    return df.select("pixel_id", r4("mm", 6).alias("mm"), r4("z", 6).alias("z"))


@query(
    "b22_bivariate_class",
    "pixels",
    "SELECT pixel_id, "
    + ", ".join("CAST(" + " + ".join(f"CAST({c} > q{c}[{i}] AS INT)" for i in range(1, 5)) + f" AS INT) AS class_{n}" for c, n in (("npv", "a"), ("carbon", "b")))
    + " FROM pixels, (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.2, 0.4, 0.6, 0.8]) AS q{c}" for c in ("npv", "carbon"))
    + " FROM pixels) z",
)
def b22(t):
    return S.bivariate_class(t.pixels, "npv", "carbon", 5).select("pixel_id", "class_a", "class_b")
