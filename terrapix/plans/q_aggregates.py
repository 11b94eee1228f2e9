"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r4
from ..operators import aggregates as A
from ..operators import scalar as S
from ..operators import spatial as G
from ..sources.tables import scratch
from .q_scalar import CARBON, LNCS, _lncs, _sql
from .registry import query


def rounded(df, *keys, places: int = 4):
    """Keys as they are, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[r4(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys])


def polygons(t):
    return G.rectangles(t.states.withColumn("name", F.lower("name")))


STATE = "JOIN states s ON lat > lat_lo AND lat < lat_hi AND lon > lon_lo AND lon < lon_hi"
POLICY = "substr(policy_category, 1, 2)"


@query(
    "d5_area_weighted_by_region",
    "pixels states",
    f"""SELECT upper(name) AS name, round(sum(area_m2 / 1e4), 4) AS hectares, count(*) AS cells, round(sum(prob * area_m2 / 1e4) / sum(area_m2 / 1e4), 4) AS prob,
        round(sum(carbon * area_m2 / 1e4) / sum(area_m2 / 1e4), 4) AS carbon, round(sum(npv * area_m2 / 1e4) / sum(area_m2 / 1e4), 4) AS npv
        FROM pixels {STATE} GROUP BY 1""",
)
def d5(t):
    labelled = G.label_points(t.pixels, polygons(t), "pixel_id", "name").where("name is not null")
    return rounded(A.area_weighted(labelled, "name", ["prob", "carbon", "npv"]), "name", "cells").orderBy(F.desc("hectares"), "name")


@query("d1_pixel_mean", "npv", "SELECT pixel_id, analysis_year, round(avg(npv_usd), 4) AS mean FROM npv GROUP BY 1, 2")
def d1(t):
    return rounded(A.group_mean(t.npv, ["pixel_id", "analysis_year"], "npv_usd"), "pixel_id")


SUMMARY = "round(sum({v}), 2) AS total, count({v}) AS n, round(min({v}), 2) AS lowest, round(max({v}), 2) AS highest, round(sum({v}) / count({v}), 2) AS mean"


@query("d2_npv_summary", "npv", f"SELECT policy_category, analysis_year, {SUMMARY.format(v='npv_usd')} FROM npv GROUP BY 1, 2")
def d2(t):
    return rounded(A.summary(t.npv, ["policy_category", "analysis_year"], "npv_usd"), "policy_category", places=2)


@query("d2_npv_summary_by_batches", "npv", f"SELECT policy_category, analysis_year, {SUMMARY.format(v='npv_usd')} FROM npv GROUP BY 1, 2")
def d2b(t):
    path, keys = scratch(t.spark, "states"), ["policy_category", "analysis_year"]
    for part in (3, 1, 0, 2, 1):  # in any order, one of them twice
        A.write_state(t.npv.where(F.col("pixel_id") % 4 == part), path, f"b{part}", keys, "npv_usd")
    return rounded(A.read_summary(t.spark, path, keys), "policy_category", places=2)


@query(
    "d3_npv_viability_by_batches",
    "alts",
    f"""SELECT rcp_category, analysis_year, {SUMMARY.format(v='npv_agri')}, round(avg(cost_usd), 2) AS mean_cost,
        round(avg(CASE WHEN npv_agri > 0 THEN 1e0 ELSE 0e0 END) * 100, 2) AS viable_pct FROM alts GROUP BY 1, 2""",
)
def d3c(t):
    path, keys = scratch(t.spark, "states"), ["rcp_category", "analysis_year"]
    for part in (1, 0, 1):
        A.write_state(t.alts.where(F.col("pixel_id") % 2 == part), path, f"b{part}", keys, "npv_agri", "cost_usd")
    return rounded(A.read_summary(t.spark, path, keys, True, True), "rcp_category", places=2)


@query(
    "d3_npv_viability",
    "alts",
    f"""SELECT rcp_category, analysis_year, {SUMMARY.format(v='npv_agri')}, round(avg(cost_usd), 2) AS mean_cost,
        round(avg(CASE WHEN npv_agri > 0 THEN 1e0 ELSE 0e0 END) * 100, 2) AS viable_pct FROM alts GROUP BY 1, 2""",
)
def d3(t):
    return rounded(A.summary(t.alts, ["rcp_category", "analysis_year"], "npv_agri", "cost_usd", True), "rcp_category", places=2)


@query(
    "d3_rcp_mean_of_years",
    "alts",
    "SELECT rcp_category, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, count(m) AS n FROM (SELECT rcp_category, analysis_year, avg(npv_agri) AS m FROM alts GROUP BY 1, 2) x GROUP BY 1",
)
def d3b(t):
    return rounded(A.mean_of_means(t.alts, ["analysis_year"], ["rcp_category"], "npv_agri"), "rcp_category")


@query(
    "d4_alternative_summaries",
    "alts",
    f"""SELECT 'forest' AS kind, rcp_category, analysis_year, {SUMMARY.format(v='npv_forest')} FROM alts GROUP BY 2, 3
        UNION ALL SELECT 'natural', rcp_category, analysis_year, {SUMMARY.format(v='npv_natural')} FROM alts GROUP BY 2, 3""",
)
def d4(t):
    one = lambda k: rounded(A.summary(t.alts, ["rcp_category", "analysis_year"], f"npv_{k}"), "rcp_category", places=2).withColumn("kind", F.lit(k))
    return one("forest").unionByName(one("natural"))


@query("d6_weighted_mean", "pixels", "SELECT state_key, round(sum(npv * area_m2) / sum(area_m2), 4) AS mean FROM pixels GROUP BY 1")
def d6(t):
    return rounded(A.weighted_mean(t.pixels, ["state_key"], "npv", "area_m2"), "state_key")


@query(
    "d7_state_npv_totals",
    "pixels",
    """SELECT state_key, round(sum(npv * (area_m2 / 1e4)), 2) AS total, round(sum(area_m2 / 1e4), 2) AS hectares, count(*) AS n,
       round(sum(npv * (area_m2 / 1e4)) / sum(area_m2 / 1e4), 2) AS per_ha, round(sum(npv * (area_m2 / 1e4)) / 1e9, 4) AS billions, count(*) FILTER (npv > 0) AS profit,
       count(*) FILTER (npv < 0) AS loss, count(*) FILTER (npv = 0) AS zero FROM pixels GROUP BY 1""",
)
def d7(t):
    df = A.profit_totals(t.pixels, "state_key", "npv")
    return rounded(df.drop("billions"), "state_key", places=2).join(df.select("state_key", r4("billions").alias("billions")), "state_key")


@query(
    "d8_decile_extremes",
    "pixels",
    """SELECT round(avg(v) FILTER (up <= k), 4) AS lowest_mean, round(avg(v) FILTER (down <= k), 4) AS highest_mean, CAST(max(k) AS BIGINT) AS k
       FROM (SELECT v, row_number() OVER (ORDER BY v, state_key) AS up, row_number() OVER (ORDER BY v DESC, state_key) AS down, greatest(floor(count(*) OVER () / 10), 1) AS k
             FROM (SELECT state_key, sum(npv) AS v FROM pixels GROUP BY 1) a) b""",
)
def d8(t):
    return rounded(A.decile_extremes(t.pixels.groupBy("state_key").agg(F.sum("npv").alias("v")), "v", "state_key"), "k")


@query(
    "d9_coarsen",
    "pixels",
    """SELECT CAST(floor(lat_idx / 30) AS BIGINT) AS block_lat, CAST(floor(lon_idx / 30) AS BIGINT) AS block_lon, round(avg(npv), 4) AS npv, count(npv) AS n
       FROM pixels WHERE lat_idx < 390 AND lon_idx < 390 GROUP BY 1, 2""",
)
def d9(t):
    return rounded(A.coarsen(t.pixels, 30, "npv", "mean", 400, 400), "block_lat", "block_lon")


@query(
    "d10_class_fractions",
    "pixels",
    "SELECT CAST(floor(lat_idx / 10) AS BIGINT) AS block_lat, CAST(floor(lon_idx / 10) AS BIGINT) AS block_lon, "
    + ", ".join(f"round(count(*) FILTER (landcover = {k}) / count(landcover), 4) AS f{k}" for k in range(1, 10))
    + " FROM pixels GROUP BY 1, 2",
)
def d10(t):
    return rounded(A.class_fractions(t.pixels, 10, "landcover"), "block_lat", "block_lon")


BIN = "CASE WHEN {x} >= {a} AND {x} <= {b} THEN CAST(least(floor(({x} - {a}) / (({b} - {a}) / {n})), {n} - 1) AS INT) END"
BX, BY = BIN.format(x="lon", a="(-120e0)", b="(-80e0)", n=16), BIN.format(x="lat", a="26e0", b="44e0", n=12)


@query(
    "d11_rect_bin_mean",
    "pixels",
    f"""SELECT bx, by_ AS by, count(*) AS n, round(avg(npv), 4) AS npv, round(-120e0 + (bx + 0.5e0) * 2.5e0, 4) AS centre_lon, round(26e0 + (by_ + 0.5e0) * 1.5e0, 4) AS centre_lat
        FROM (SELECT {BX} AS bx, {BY} AS by_, npv FROM pixels) b WHERE bx IS NOT NULL AND by_ IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def d11(t):
    return rounded(A.rect_bin_mean(t.pixels, (-120.0, -80.0, 26.0, 44.0), 16, 12, ["npv"]), "bx", "by")


@query(
    "d12_hist2d",
    "pixels",
    f"SELECT bx, by_ AS by, count(*) AS n FROM (SELECT {BX} AS bx, {BY} AS by_ FROM pixels) b WHERE bx IS NOT NULL AND by_ IS NOT NULL GROUP BY 1, 2",
)
def d12(t):
    return A.hist2d(t.pixels, (-120.0, -80.0, 26.0, 44.0), 16, 12)


HEX = """SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q,
                CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r
         FROM (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs - fs) AS ds
               FROM (SELECT *, round_even(fq, 0) AS rq, round_even(fr, 0) AS rr, round_even(fs, 0) AS rs
                     FROM (SELECT *, -fq - fr AS fs FROM (SELECT *, (lon * (pow(3e0, 0.5e0) / 3) - lat / 3) / 1.5e0 AS fq, (lat * (2e0 / 3e0)) / 1.5e0 AS fr FROM pixels) a) b) c) d"""


@query(
    "d13_hex_agg",
    "pixels",
    f"""SELECT h.q, h.r, n, npv, carbon, landcover FROM (
          SELECT q, r, count(*) AS n, round(avg(npv), 4) AS npv, round(quantile_cont(CASE WHEN carbon > 0 THEN carbon END, 0.75), 4) AS carbon FROM ({HEX}) x GROUP BY 1, 2) h
        JOIN (SELECT q, r, landcover, row_number() OVER (PARTITION BY q, r ORDER BY count(*) DESC, landcover) AS k FROM ({HEX}) y GROUP BY 1, 2, 3) m ON h.q = m.q AND h.r = m.r AND k = 1""",
)
def d13(t):
    return rounded(A.hex_agg(t.pixels, 1.5, ["npv"], ["carbon"], ["landcover"]), "q", "r")


@query(
    "d14_lat_band_ci",
    "pixels",
    "SELECT floor(lat / 0.5e0) * 0.5e0 AS band, round(avg(npv), 6) AS mean, round(quantile_cont(npv, 0.025), 6) AS low, round(quantile_cont(npv, 0.975), 6) AS high, count(*) AS n FROM pixels GROUP BY 1",
)
def d14(t):
    return rounded(A.lat_band_ci(t.pixels, "npv"), places=6)


@query(
    "d15_weighted_histogram",
    "pixels",
    """SELECT CAST(least(floor((npv - e[1]) / ((e[2] - e[1]) / 20)), 19) AS INT) AS bin, round(sum(area_m2), 2) AS weight, count(*) AS n
       FROM pixels, (SELECT quantile_cont(npv, [0.01, 0.99]) AS e FROM pixels) z WHERE npv >= e[1] AND npv <= e[2] GROUP BY 1""",
)
def d15(t):
    return rounded(A.weighted_histogram(t.pixels, "npv", "area_m2", 20), "bin", places=2)


@query(
    "d16_quantile_table",
    "pixels",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, " + ", ".join(f"round(quantile_cont({c}, {q}), 4) AS q{round(q * 1000)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM pixels" for c in ("npv", "carbon", "prob")
    ),
)
def d16(t):
    return rounded(A.quantile_table(t.pixels, ["npv", "carbon", "prob"], [0.05, 0.25, 0.5, 0.75, 0.95]), "name")


@query(
    "d17_pivot_state_year",
    "demand",
    "SELECT state, scenario, " + ", ".join(f"round(sum(mmbtu) FILTER (year = {y}), 4) AS \"{y}\"" for y in (2020, 2030, 2040, 2050)) + " FROM demand GROUP BY 1, 2",
)
def d17(t):
    return rounded(A.pivot(t.demand, ["state", "scenario"], "year", [2020, 2030, 2040, 2050], "mmbtu"), "state")


@query(
    "d17_pivot_policy",
    "npv",
    f"SELECT pixel_id, round(avg(npv_usd) FILTER ({POLICY} = 'P1'), 4) AS \"P1\", round(avg(npv_usd) FILTER ({POLICY} = 'P2'), 4) AS \"P2\", round(avg(npv_usd) FILTER ({POLICY} = 'P3'), 4) AS \"P3\" FROM npv GROUP BY 1",
)
def d17b(t):
    return rounded(A.pivot(t.npv.withColumn("p", S.policy_group(F.col("policy_category"))), ["pixel_id"], "p", ["P1", "P2", "P3"], "npv_usd", "mean"), "pixel_id")


CROPS = ["maize_rcp26_kg_dw_ha", "wheat_rcp26_10kg_dw_ha", "soybean_rcp26_kg_dw_ha"]


@query("d18_unpivot_crops", "crops", " UNION ALL ".join(f"SELECT pixel_id, '{c}' AS name, {c} AS value FROM crops WHERE {c} > 0" for c in CROPS))
def d18(t):
    return A.unpivot_positive(t.crops, ["pixel_id"], CROPS)


@query(
    "d19_energy_rollup",
    "demand",
    """SELECT state, scenario, sector, year, CAST(grouping(sector) AS INT) AS all_sectors, sum(mmbtu) AS mmbtu FROM demand
       WHERE final_energy = 'ELECTRICITY' AND year BETWEEN 2017 AND 2050 GROUP BY GROUPING SETS ((state, scenario, sector, year), (state, scenario, year))""",
)
def d19(t):
    return A.energy_rollup(t.demand)


@query(
    "d20_mean_scenario",
    "demand",
    """SELECT state, sector, year, scenario, round(mmbtu, 4) AS mmbtu FROM demand
       UNION ALL SELECT state, sector, year, 'MEAN SCENARIO', round(avg(mmbtu), 4) FROM demand GROUP BY 1, 2, 3""",
)
def d20(t):
    return rounded(A.mean_scenario(t.demand, ["state", "sector", "year"], "mmbtu"), "state")


SUIT = ["jatropha_class", "miscanthus_class", "oilpalm_class"]


@query(
    "d21_crop_suitability",
    "crops pixels",
    " UNION ALL ".join(
        f"SELECT '{c}' AS crop, " + ", ".join(f"round(count(*) FILTER ({w}) / count(*) * 100, 4) AS pct_{k}, round(coalesce(sum(area_m2) FILTER ({w}), 0) / 1e7, 4) AS kha_{k}" for k, w in (("one", f"{c} = 1"), ("two", f"{c} = 2"), ("other", f"{c} NOT IN (1, 2)")))
        + " FROM crops c JOIN pixels p ON c.pixel_id = p.pixel_id"
        for c in SUIT
    ),
)
def d21(t):
    return rounded(A.crop_suitability(t.crops.join(t.pixels.select("pixel_id", "area_m2"), "pixel_id"), SUIT), "crop")


@query("d22_perennial_cells", "crops", "SELECT pixel_id FROM crops WHERE jatropha_class IN (1, 2) OR miscanthus_class IN (1, 2) OR oilpalm_class IN (1, 2)")
def d22(t):
    return A.perennial_cells(t.crops, SUIT, "pixel_id")


LOST = "SELECT pixel_id, avg(w_agri * npv_agri) + avg(w_forest * npv_forest) + avg(w_natural * npv_natural) AS opp FROM alts GROUP BY 1"
WATER = "round(avg(rev), 4) AS revenue, round(avg(cost), 4) AS cost, round(avg(opp), 4) AS opportunity, round(avg(rev) - avg(cost) - avg(opp), 4) AS net"


@query(
    "d23_waterfall",
    "npv alts",
    f"""WITH o AS ({LOST})
        SELECT policy, {WATER} FROM (SELECT {POLICY} AS policy, pixel_id, avg(npv_usd + cost_usd) AS rev, avg(cost_usd) AS cost FROM npv GROUP BY 1, 2) a JOIN o ON a.pixel_id = o.pixel_id GROUP BY 1
        UNION ALL SELECT 'Overall', {WATER} FROM (SELECT pixel_id, avg(npv_usd + cost_usd) AS rev, avg(cost_usd) AS cost FROM npv GROUP BY 1) a JOIN o ON a.pixel_id = o.pixel_id""",
)
def d23(t):
    return rounded(A.waterfall(t.npv, t.alts, S.policy_group(F.col("policy_category"))), "policy")


def _t_critical(nu: str) -> str:
    """The 97.5 % point of t by its expansion around the normal one, which is exact to many digits for large ``nu``."""
    z = 1.959963984540054
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return "(" + " + ".join(f"{c!r} / pow({nu}, {i})" for i, c in enumerate(terms)) + ")"


T_CRITICAL = _t_critical("(count(*) - 1)")


@query(
    "d24_policy_path_stats",
    "npv",
    f"""SELECT policy, count(*) AS pixels, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, round(min(m), 4) AS lowest, round(max(m), 4) AS highest, round(sum(good) / sum(paths), 4) AS positive,
        round(avg(m) - {T_CRITICAL} * stddev_samp(m) / sqrt(count(*)), 4) AS low, round(avg(m) + {T_CRITICAL} * stddev_samp(m) / sqrt(count(*)), 4) AS high
        FROM (SELECT {POLICY} AS policy, pixel_id, avg(npv_usd) AS m, count(*) AS paths, count(*) FILTER (npv_usd > 0) AS good FROM npv GROUP BY 1, 2) a GROUP BY 1""",
)
def d24(t):
    return rounded(A.policy_path_stats(t.npv, S.policy_group(F.col("policy_category")), "npv_usd"), "policy")


YEARLY = f"""SELECT policy, analysis_year, avg(m) AS mean, stddev_samp(m) AS sd, count(m) AS n, quantile_cont(m, 0.25) AS q25, quantile_cont(m, 0.75) AS q75
    FROM (SELECT {POLICY} AS policy, analysis_year, pixel_id, avg(npv_usd) AS m FROM npv GROUP BY 1, 2, 3) a GROUP BY 1, 2"""


@query("d25_policy_year_stats", "npv", f"SELECT policy, analysis_year, round(mean, 4) AS mean, round(sd, 4) AS sd, n, round(q25, 4) AS q25, round(q75, 4) AS q75 FROM ({YEARLY}) y")
def d25(t):
    return rounded(A.policy_year_stats(t.npv, S.policy_group(F.col("policy_category")), "npv_usd"), "policy")


@query(
    "d25_over_years_ci",
    "npv",
    f"""SELECT policy, round(o, 4) AS overall, round(se, 4) AS se, round(o - 1.96e0 * se, 4) AS low, round(o + 1.96e0 * se, 4) AS high
        FROM (SELECT policy, avg(mean) AS o, stddev_samp(mean) / sqrt(count(mean)) AS se FROM ({YEARLY}) y GROUP BY 1) z""",
)
def d25b(t):
    return rounded(A.over_years_ci(A.policy_year_stats(t.npv, S.policy_group(F.col("policy_category")), "npv_usd"), ["policy"]), "policy")


@query(
    "d26_opportunity_by_state_zone",
    "alts pixels",
    """SELECT zone, rcp_category, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, count(m) AS n
       FROM (SELECT state_key % 4 AS zone, rcp_category, state_key, avg(npv_agri + npv_forest + npv_natural) AS m FROM alts a JOIN pixels p ON a.pixel_id = p.pixel_id GROUP BY 1, 2, 3) s GROUP BY 1, 2""",
)
def d26(t):
    states = t.pixels.select("pixel_id", "state_key").hint("shuffle_hash")  # a task holds its cells once, not sorted rows by scenario and year
    df = t.alts.join(states, "pixel_id").withColumns({"zone": F.col("state_key") % 4, "v": F.col("npv_agri") + F.col("npv_forest") + F.col("npv_natural")})
    return rounded(A.mean_of_means(df, ["state_key"], ["zone", "rcp_category"], "v"), "zone", "rcp_category")


@query("d27_duplicates_report", "npv", "SELECT pixel_id, scenario_id, count(*) AS n FROM npv GROUP BY 1, 2 HAVING count(*) > 1")
def d27(t):
    return A.duplicates_report(t.npv, ["pixel_id", "scenario_id"])


@query("d28_missing_report", "scen_wide crops", "SELECT 'wheat_rcp26_10kg_dw_ha' AS name, count(*) FILTER (wheat_rcp26_10kg_dw_ha IS NULL) AS missing FROM crops")
def d28(t):
    return A.missing_report(t.crops)


@query(
    "d29_quality_report",
    "pixels",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL OR isnan({c})) AS nans, count(*) FILTER (isinf({c})) AS infs, count(*) FILTER ({c} = 0) AS zeros, round(var_pop({c}), 0) AS variance FROM pixels" for c in ("npv", "carbon", "prob", "wind")
    ),
)
def d29(t):
    return rounded(A.quality_report(t.pixels, ["npv", "carbon", "prob", "wind"]), "name", places=0)


FOUR = ("npv", "carbon", "prob", "wind")
MEANS = ", ".join(f"var_pop({c}) AS v{i}" for i, c in enumerate(FOUR))


@query(
    "d29_quality_summary",
    "pixels",
    f"""SELECT n AS n_rows, CAST(nans AS BIGINT) AS nans, CAST(infs AS BIGINT) AS infs, CAST(zeros AS BIGINT) AS zeros, round(least(v0, v1, v2, v3), 0) AS least_variance, round(greatest(v0, v1, v2, v3), 0) AS greatest_variance,
        CAST({' + '.join(f'CAST(v{i} <= 1e-12 AS INT)' for i in range(4))} AS BIGINT) AS no_variance, CAST({' + '.join(f'CAST(v{i} <= 1e-4 AS INT)' for i in range(4))} AS BIGINT) AS low_variance
        FROM (SELECT count(*) AS n, {MEANS}, {' + '.join(f'count(*) FILTER ({c} IS NULL OR isnan({c}))' for c in FOUR)} AS nans, {' + '.join(f'count(*) FILTER (isinf({c}))' for c in FOUR)} AS infs, {' + '.join(f'count(*) FILTER ({c} = 0)' for c in FOUR)} AS zeros FROM pixels) s""",
)
def d29b(t):
    return rounded(A.quality_summary(t.pixels, list(FOUR)).drop("condition"), "n_rows", "nans", "infs", "zeros", "no_variance", "low_variance", places=0)


MOMENTS = """SELECT '{c}' AS name, s.n, round(mu, 4) AS mean, round(sd, 4) AS sd, round(sk, 4) AS skew, round(ku, 4) AS kurt, round(q[2], 4) AS median,
    (SELECT count(*) FROM pixels WHERE {c} < q[1] - 1.5e0 * (q[3] - q[1]) OR {c} > q[3] + 1.5e0 * (q[3] - q[1])) AS iqr_outliers, (SELECT count(*) FROM pixels WHERE abs({c} - mu) > 2.5e0 * sd) AS z_outliers,
    CASE WHEN abs(sk) <= 0.5e0 THEN 'none' WHEN sk > 1 THEN 'log' WHEN sk > 0.5e0 THEN 'sqrt' ELSE 'square' END AS advice
    FROM (SELECT count({c}) AS n, avg({c}) AS mu, stddev_samp({c}) AS sd, quantile_cont({c}, [0.25, 0.5, 0.75]) AS q,
          (sum(pow({c} - m, 3)) / count(*)) / pow(sum(pow({c} - m, 2)) / count(*), 1.5e0) AS sk, (sum(pow({c} - m, 4)) / count(*)) / pow(sum(pow({c} - m, 2)) / count(*), 2) - 3 AS ku
          FROM pixels, (SELECT avg({c}) AS m FROM pixels) z) s"""


@query("d30_describe_shape", "pixels", " UNION ALL ".join(MOMENTS.format(c=c) for c in ("npv", "carbon", "wind")))
def d30(t):
    return rounded(A.describe_shape(t.pixels, ["npv", "carbon", "wind"]), "name")


def _tercile(c):
    return f"CASE WHEN {c} <= q{c}[1] THEN 'Low' WHEN {c} <= q{c}[2] THEN 'Mid' ELSE 'High' END"


@query(
    "d31_three_way_counts",
    "pixels",
    f"SELECT {_tercile('npv')} AS a, {_tercile('carbon')} AS b, {_tercile('prob')} AS c, count(*) AS n FROM pixels, (SELECT "
    + ", ".join(f"quantile_cont({c}, [CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3]) AS q{c}" for c in ("npv", "carbon", "prob"))
    + " FROM pixels) z GROUP BY 1, 2, 3",
)
def d31(t):
    df = t.pixels
    for c, out in (("npv", "a"), ("carbon", "b"), ("prob", "c")):
        df = A.quantile_groups(df, c, 3, out, (1, 2))
    return df.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query(
    "d32_county_mean",
    "pixels states",
    f"""SELECT upper(name) AS name, round(avg(least(npv, q)), 4) AS npv, round(avg(least(carbon, qc)), 4) AS carbon FROM pixels {STATE}, (SELECT quantile_cont(npv, 0.99) AS q, quantile_cont(carbon, 0.99) AS qc FROM pixels) z GROUP BY 1""",
)
def d32(t):
    df = G.label_points(S.clip_upper_quantile(t.pixels, ["npv", "carbon"]), polygons(t), "pixel_id", "name").where("name is not null")
    return df.groupBy("name").agg(r4(F.avg("npv")).alias("npv"), r4(F.avg("carbon")).alias("carbon"))


@query(
    "d33_class_by_nonzero_quantile",
    "pixels",
    "SELECT pixel_id, CAST(CASE WHEN prob = 0 THEN 0 ELSE 1 + "
    + " + ".join(f"CAST(prob > q[{i}] AS INT)" for i in range(1, 6))
    + " END AS INT) AS cls FROM pixels, (SELECT quantile_cont(CASE WHEN prob <> 0 THEN prob END, [0.1, 0.3, 0.5, 0.7, 0.9]) AS q FROM pixels) z",
)
def d33(t):
    return A.class_by_nonzero_quantile(t.pixels, "prob").select("pixel_id", "cls")


@query(
    "d34_strategy_summary",
    "pixels",
    " UNION ALL ".join(f"SELECT 'final_{n}' AS name, round(avg(fin_{a}), 4) AS mean, round(stddev_samp(fin_{a}), 4) AS sd FROM ({LNCS}) l{a}" for a, n in (("f", "forest"), ("a", "agro"), ("v", "veg"))),
)
def d34(t):
    return rounded(A.mean_sd_table(_lncs(t), ["final_forest", "final_agro", "final_veg"]), "name")


@query(
    "d35_npv_totals_national",
    "pixels",
    "SELECT round(sum(carbon * (area_m2 / 1e4)) / 1e9, 6) AS gt_c, round(sum(carbon * (area_m2 / 1e4)) * 3.667e0 / 1e9, 6) AS gt_co2, round(stddev_samp(carbon) / sqrt(count(carbon)), 6) AS se FROM pixels",
)
def d35(t):
    return rounded(A.national_totals(t.pixels, "carbon"), places=6)


POST = """SELECT vec_id, list_transform([1, 2, 3, 4], lambda i: abs(CAST(embedding[i] AS DOUBLE)) / (abs(CAST(embedding[1] AS DOUBLE)) + abs(CAST(embedding[2] AS DOUBLE)) + abs(CAST(embedding[3] AS DOUBLE)) + abs(CAST(embedding[4] AS DOUBLE)))) AS p
    FROM embeddings WHERE embedding IS NOT NULL"""


def posterior(t, n: int = 4):
    """A made-up posterior over components: the first components of a vector, as shares."""
    e = F.transform(F.slice("embedding", 1, n), lambda x: F.abs(x.cast("double")))
    total = F.aggregate(F.col("e"), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.where("embedding is not null").select("vec_id", "label", e.alias("e")).select("vec_id", "label", F.transform("e", lambda x: x / total).alias("p"))


@query(
    "d36_component_stats",
    "",
    f"""SELECT CAST(i - 1 AS INT) AS component, round(avg(p[i]), 6) AS mean_p, count(*) FILTER (list_position(p, list_max(p)) = i) AS dominant
        FROM ({POST}) x, (VALUES (1), (2), (3), (4)) AS k(i) GROUP BY 1""",
)
def d36(t):
    return rounded(A.component_stats(posterior(t), "p"), "component", places=6)


@query(
    "d36_cluster_stats",
    "",
    f"""SELECT CAST(c AS INT) AS cluster, round(CASE c WHEN 1 THEN avg(p[1] + p[3]) ELSE avg(p[2] + p[4]) END, 6) AS mean_p, count(*) FILTER ((list_position(p, list_max(p)) % 2 = 1) = (c = 1)) AS dominant
        FROM ({POST}) x, (VALUES (1), (2)) AS k(c) GROUP BY c""",
)
def d36b(t):
    return rounded(A.cluster_stats(posterior(t), "p", {1: [0, 2], 2: [1, 3]}), "cluster", "dominant", places=6)
