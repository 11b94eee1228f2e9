"""Queries of the ordered operators and yearly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r4
from ..operators import aggregates as A
from ..operators import ranking as R
from ..operators import scalar as S
from ..operators import series as T
from .q_aggregates import POLICY, rounded
from .registry import query


@query("e1_dedup_keep_last", "npv", "SELECT pixel_id, analysis_year, max(scenario_id) AS scenario_id FROM npv GROUP BY 1, 2")
def e1(t):
    return R.dedup_keep_last(t.npv, ["pixel_id", "analysis_year"], ["scenario_id", "model_id", "npv_usd"]).select("pixel_id", "analysis_year", "scenario_id")


TWO_YEARS = "SELECT lat_idx, lon_idx, year, unique_id FROM sites UNION ALL SELECT lat_idx, lon_idx, 2019, unique_id FROM sites WHERE unique_id % 3 = 0"


@query(
    "e2_dedup_prefer",
    "sites",
    f"SELECT lat_idx, lon_idx, year, unique_id FROM (SELECT *, row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY year = 2020 DESC, year, unique_id) AS k FROM ({TWO_YEARS}) u) v WHERE k = 1",
)
def e2(t):
    rows = t.sites.select("lat_idx", "lon_idx", "year", "unique_id")
    both = rows.union(rows.where("unique_id % 3 = 0").withColumn("year", F.lit(2019)).select(rows.columns))
    return R.dedup_prefer(both, ["lat_idx", "lon_idx"], "year", 2020, ["year", "unique_id"])


@query(
    "e3_cumulative_curve",
    "pixels",
    """SELECT row_number() OVER w AS rank, round(row_number() OVER w / count(*) OVER () * 100, 6) AS pct, round(sum(npv) OVER (ORDER BY prob DESC, pixel_id ROWS UNBOUNDED PRECEDING), 2) AS cumulative
       FROM pixels WINDOW w AS (ORDER BY prob DESC, pixel_id) UNION ALL SELECT 0, 0e0, 0e0""",
)
def e3(t):
    return R.cumulative_curve(t.pixels, "prob", "npv", "pixel_id").select("rank", r4("pct", 6).alias("pct"), r4("cumulative", 2).alias("cumulative"))


EFF = "sum({v} * (area_m2 / 1e4) * (n - k + 0.5e0) / n) / sum(area_m2 / 1e4)"
RANKED = "SELECT *, row_number() OVER (ORDER BY {o} DESC, pixel_id) AS k, count(*) OVER () AS n FROM pixels"


@query("e4_performance_efficiency", "pixels", f"SELECT round({EFF.format(v='npv')}, 4) AS efficiency FROM ({RANKED.format(o='prob')}) r")
def e4(t):
    return R.performance_efficiency(t.pixels, "prob", "npv", "pixel_id").select(r4("efficiency").alias("efficiency"))


METRICS = ["prob", "carbon", "npv"]
CROSS = " UNION ALL ".join(f"SELECT '{o}' AS sorted_by, '{v}' AS target, {EFF.format(v=v)} AS efficiency FROM ({RANKED.format(o=o)}) r" for o in METRICS for v in METRICS)


@query("e5_cross_sort_scores", "pixels", f"SELECT sorted_by, target, round(efficiency, 4) AS efficiency FROM ({CROSS}) c")
def e5(t):
    return rounded(R.cross_sort_scores(t.pixels, METRICS, "pixel_id"), "sorted_by", "target")


@query(
    "e5_score_spread",
    "pixels",
    f"""WITH c AS ({CROSS}) SELECT c.sorted_by, round(avg(c.efficiency / o.efficiency), 4) AS mean, round(stddev_samp(c.efficiency / o.efficiency), 4) AS sd,
        round(stddev_samp(c.efficiency / o.efficiency) / avg(c.efficiency / o.efficiency), 4) AS cv,
        round(avg(c.efficiency / o.efficiency) - 4.302652729911275e0 * stddev_samp(c.efficiency / o.efficiency) / sqrt(3), 4) AS low, round(avg(c.efficiency / o.efficiency) + 4.302652729911275e0 * stddev_samp(c.efficiency / o.efficiency) / sqrt(3), 4) AS high
        FROM c JOIN c o ON c.target = o.target AND o.sorted_by = o.target GROUP BY 1""",
)
def e5b(t):
    return rounded(R.score_spread(R.cross_sort_scores(t.pixels, METRICS, "pixel_id")), "sorted_by")


@query(
    "e6_capacity_target",
    "pixels",
    """SELECT count(*) AS cells, round(sum(area_m2 / 1e4), 2) AS hectares, round(sum(kw), 2) AS kw, round(sum(npv), 2) AS npv
       FROM (SELECT *, sum(kw) OVER (ORDER BY prob DESC, pixel_id ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, area_m2 * 0.17e0 AS kw FROM pixels) p) q WHERE c - kw < 1e8""",
)
def e6(t):
    df = t.pixels.withColumn("kw", S.capacity_kw(F.col("area_m2")))
    return rounded(R.capacity_target(df, "prob", 1e8, "kw", ["npv"], "pixel_id").withColumnRenamed("capacity", "kw_"), "cells", places=2).withColumnRenamed("kw_", "kw")


NEED = "SELECT state_key, 2e8 + 1e7 * (state_key % 9) AS demand FROM states"


def _need(t):
    return t.states.select("state_key", (2e8 + 1e7 * (F.col("state_key") % 9)).alias("demand"))


@query(
    "e7_demand_cutoff",
    "pixels states",
    f"""SELECT pixel_id, c - area_m2 >= demand AS beyond FROM (SELECT pixel_id, state_key, area_m2,
        sum(area_m2) OVER (PARTITION BY state_key ORDER BY prob DESC, pixel_id ROWS UNBOUNDED PRECEDING) AS c FROM pixels) p JOIN ({NEED}) d ON p.state_key = d.state_key""",
)
def e7(t):
    return R.demand_cutoff(t.pixels, _need(t), "state_key", "prob", "area_m2", "pixel_id").select("pixel_id", "beyond")


@query(
    "e7_demand_met",
    "pixels states",
    f"""SELECT state_key, count(*) FILTER (NOT beyond) AS needed, sum(area_m2) AS power, max(demand) AS demand, sum(area_m2) >= max(demand) AS met, greatest(max(demand) - sum(area_m2), 0e0) AS lacking
        FROM (SELECT p.state_key, area_m2, demand, c - area_m2 >= demand AS beyond FROM (SELECT pixel_id, state_key, area_m2,
              sum(area_m2) OVER (PARTITION BY state_key ORDER BY prob DESC, pixel_id ROWS UNBOUNDED PRECEDING) AS c FROM pixels) p JOIN ({NEED}) d ON p.state_key = d.state_key) z GROUP BY 1""",
)
def e7b(t):
    return R.demand_met(R.demand_cutoff(t.pixels, _need(t), "state_key", "prob", "area_m2", "pixel_id"), "state_key", "area_m2")


def _integral_sql():
    parts = []
    for o in METRICS:
        parts.append(
            f"""SELECT state_key, '{o}' AS sorted_by, {', '.join(f"sum({v} * (area_m2 / 1e4) * (200 - i - 0.5e0 - CASE WHEN i = 0 THEN 0.5e0 ELSE 0e0 END) / 199) AS {v}" for v in METRICS)}
            FROM pixels, (SELECT i, e[i + 1] AS hi, e[i + 2] AS lo FROM (SELECT quantile_cont({o}, [1 - CAST(x AS DOUBLE) / 200 FOR x IN range(201)]) AS e FROM pixels) q, (SELECT unnest(range(200)) AS i) r) b
            WHERE {o} <= hi AND {o} >= lo GROUP BY 1"""
        )
    return " UNION ALL ".join(parts)


@query("e8_state_integrals", "pixels", f"SELECT state_key, sorted_by, {', '.join(f'round({v}, 2) AS {v}' for v in METRICS)} FROM ({_integral_sql()}) z")
def e8(t):
    return rounded(R.state_integrals(t.pixels, "state_key", METRICS, METRICS), "state_key", "sorted_by", places=2)


LONG = " UNION ALL ".join(f"SELECT state_key, sorted_by, '{v}' AS metric, {v} AS v FROM z" for v in METRICS)
IMPROVE = f"""SELECT l.state_key, l.metric, avg(CASE WHEN l.v <> 0 THEN (o.v - l.v) / abs(l.v) * 100 END) AS mean, stddev_samp(CASE WHEN l.v <> 0 THEN (o.v - l.v) / abs(l.v) * 100 END) AS sd, count(CASE WHEN l.v <> 0 THEN 1 END) AS n
    FROM l JOIN l o ON l.state_key = o.state_key AND l.metric = o.metric AND o.sorted_by = 'npv' WHERE l.sorted_by <> 'npv' GROUP BY 1, 2"""


@query("e9_improvement_vs_others", "pixels", f"WITH z AS ({_integral_sql()}), l AS ({LONG}) SELECT state_key, metric, round(mean, 4) AS mean, round(sd, 4) AS sd, n, round(sd / sqrt(n), 4) AS se FROM ({IMPROVE}) y")
def e9(t):
    return rounded(R.improvement_vs_others(R.state_integrals(t.pixels, "state_key", METRICS, METRICS), "state_key", "npv", METRICS), "state_key", "metric")


@query(
    "e9_combined",
    "pixels",
    f"""WITH z AS ({_integral_sql()}), l AS ({LONG}) SELECT state_key, round(m, 3) AS mean, round(se, 3) AS se, round(m - 1.96e0 * se, 3) AS low, round(m + 1.96e0 * se, 3) AS high
        FROM (SELECT state_key, avg(mean) AS m, sqrt(sum(pow(sd / sqrt(n), 2))) / count(*) AS se FROM ({IMPROVE}) y GROUP BY 1) x""",
)
def e9b(t):
    one = R.improvement_vs_others(R.state_integrals(t.pixels, "state_key", METRICS, METRICS), "state_key", "npv", METRICS)
    return rounded(R.combine_dimensions(one, "state_key"), "state_key", places=3)


STRING = "SELECT pixel_id, string_agg(CASE WHEN code IN (1, 7) THEN CAST(code AS VARCHAR) ELSE '0' END, '' ORDER BY year) AS s, min(year) AS y0 FROM lc_series GROUP BY 1"
SPELLS = f"""SELECT pixel_id, y0 + length(regexp_extract(s, '^(.*11)(0{{5,}})(.*)$', 1)) AS start_year, length(regexp_extract(s, '^(.*11)(0{{5,}})(.*)$', 2)) AS duration,
    regexp_extract(s, '^(.*11)(0{{5,}})(.*)$', 3) AS rest FROM ({STRING}) x WHERE s LIKE '11%' AND regexp_matches(s, '^(.*11)(0{{5,}})(.*)$')"""


@query(
    "e10_detect_abandonment",
    "lc_series",
    f"""SELECT pixel_id, CAST(start_year AS INT) AS start_year, CAST(duration AS INT) AS duration, CAST(contains(rest, '11') AS INT) AS recultivated, CAST(contains(rest, '7') AS INT) AS built, CAST(length(rest) = 0 AS INT) AS current FROM ({SPELLS}) s""",
)
def e10(t):
    return T.detect_abandonment(t.lc_series, ["pixel_id"])


@query(
    "e11_candidate_mask",
    "lc_series",
    """SELECT pixel_id, count(*) FILTER (code <> 7) AS free, bool_or(code = 1) AS crop, bool_or(f) AS followed, count(*) FILTER (code <> 7) >= 5 AND bool_or(code = 1) AND bool_or(f) AS candidate
       FROM (SELECT *, code = 1 AND coalesce(lead(code, 1) OVER w <> 7 AND lead(code, 2) OVER w <> 7, false) AS f FROM lc_series WINDOW w AS (PARTITION BY pixel_id ORDER BY year)) x GROUP BY 1""",
)
def e11(t):
    return T.candidate_mask(t.lc_series, ["pixel_id"])


@query("e12_landcover_at_year", "lc_series", f"SELECT s.pixel_id, CAST(start_year AS INT) AS start_year, code FROM ({SPELLS}) s LEFT JOIN lc_series l ON s.pixel_id = l.pixel_id AND l.year = s.start_year")
def e12(t):
    return T.landcover_at_year(t.lc_series, T.detect_abandonment(t.lc_series, ["pixel_id"]).select("pixel_id", "start_year"), ["pixel_id"]).select("pixel_id", "start_year", "code")


@query(
    "e13_post_abandonment_class",
    "lc_series",
    f"""WITH r AS (SELECT l.pixel_id, l.year, l.code, code = 1 AND coalesce(lead(code) OVER (PARTITION BY l.pixel_id ORDER BY l.year) = 1, false) AS pair, row_number() OVER (PARTITION BY l.pixel_id, code ORDER BY l.year) AS k
             FROM lc_series l JOIN ({SPELLS}) s ON l.pixel_id = s.pixel_id AND l.year >= s.start_year),
        m AS (SELECT pixel_id, code, row_number() OVER (PARTITION BY pixel_id ORDER BY k DESC, year) AS o FROM r)
        SELECT r.pixel_id, CASE WHEN bool_or(pair) THEN 1 ELSE max(m.code) END AS later_class FROM r JOIN m ON r.pixel_id = m.pixel_id AND o = 1 GROUP BY 1""",
)
def e13(t):
    return T.post_abandonment_class(t.lc_series, T.detect_abandonment(t.lc_series, ["pixel_id"]), ["pixel_id"])


def _lines(view, keys, x, y, where, years, extend=False):
    """Brackets by correlated extremes, so that the oracle shares nothing with the operator."""
    k = ", ".join(keys)
    on = lambda a: " AND ".join(f"{a}.{c} = q.{c}" for c in keys)
    lo = f"(SELECT max({x}) FROM kn a WHERE {on('a')} AND {x} <= q.tx)"
    hi = f"(SELECT min({x}) FROM kn b WHERE {on('b')} AND {x} >= q.tx)"
    val = lambda z: f"(SELECT max({y}) FROM kn c WHERE {on('c')} AND c.{x} = {z})"
    return f"""WITH kn AS (SELECT {k}, {x}, {y} FROM {view} WHERE {where} AND {y} IS NOT NULL), q AS (SELECT DISTINCT {k}, tx FROM kn, (SELECT unnest([{', '.join(map(str, years))}]) AS tx) z),
        b AS (SELECT q.*, coalesce({lo}, {hi}) AS x0, coalesce({hi}, {lo}) AS x1 FROM q)
        SELECT {k}, CAST(tx AS INT) AS {x}, round(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (tx - x0) / (x1 - x0) END, 4) AS {y} FROM (SELECT q.*, {val('q.x0')} AS y0, {val('q.x1')} AS y1 FROM b q) w"""


@query("e14_interp_series", "scen_long", _lines("scen_long", ["model", "scenario", "variable"], "analysis_year", "value", "true", (2015, 2025, 2033, 2047, 2055)))
def e14(t):
    out = T.interp_series(t.scen_long, ["model", "scenario", "variable"], "analysis_year", "value", [2015, 2025, 2033, 2047, 2055])
    return rounded(out, "model", "scenario", "variable", "analysis_year")


@query(
    "e14_interp_extended",
    "intensity",
    """SELECT scenario, CAST(tx AS INT) AS year, round(CASE WHEN tx < 2030 THEN g[1] + (g[2] - g[1]) * (tx - 2020) / 10 ELSE g[3] + (g[4] - g[3]) * (tx - 2040) / 10 END, 4) AS g_per_kwh
       FROM (SELECT scenario, list(g_per_kwh ORDER BY year) AS g FROM intensity GROUP BY 1) x, (SELECT unnest([2015, 2025, 2045, 2060]) AS tx) z""",
)
def e14b(t):
    return rounded(T.interp_series(t.intensity, ["scenario"], "year", "g_per_kwh", [2015, 2025, 2045, 2060], "extend"), "scenario", "year")


@query(
    "e15_interp_between_grids",
    "alts",
    """SELECT a.pixel_id, a.rcp_category, round(a.npv_agri + (b.npv_agri - a.npv_agri) * 0.5e0, 4) AS npv_agri FROM alts a JOIN alts b ON a.pixel_id = b.pixel_id AND a.rcp_category = b.rcp_category
       WHERE a.analysis_year = 2020 AND b.analysis_year = 2030""",
)
def e15(t):
    keys = ["pixel_id", "rcp_category"]
    return rounded(T.interp_between_grids(t.alts.where("analysis_year = 2020"), t.alts.where("analysis_year = 2030"), keys, "npv_agri", 2020, 2030, 2025), *keys)


PRICES = "(SELECT scenario, lst[1] AS p20, lst[2] AS p30 FROM (SELECT scenario, list(value ORDER BY analysis_year) AS lst FROM scen_long WHERE variable = '{v}' GROUP BY 1) z)"
KW = "area_m2 * 0.17e0"


@query(
    "e16_npv_pv",
    "pixels scen_long",
    f"""WITH y AS (SELECT unnest(range(2021, 2031)) AS year),
        f AS (SELECT p.scenario, sum((p.p20 + (p.p30 - p.p20) * (year - 2020) / 10) / pow(1.05e0, year - 2020)) / 277.778e0 AS a, sum((m.p20 + (m.p30 - m.p20) * (year - 2020) / 10) / pow(1.05e0, year - 2020)) AS b
              FROM {PRICES.format(v='price')} p JOIN (SELECT scenario, max(value) FILTER (analysis_year = 2020) AS p20, max(value) FILTER (analysis_year = 2030) AS p30 FROM scen_long WHERE variable = 'om' GROUP BY 1) m ON p.scenario = m.scenario, y
              WHERE m.p20 IS NOT NULL AND m.p30 IS NOT NULL GROUP BY 1),
        k AS (SELECT scenario, value AS capex FROM scen_long WHERE variable = 'capital' AND analysis_year = 2020)
        SELECT pixel_id, f.scenario, round((rsds * area_m2 * a - {KW} * (capex + b)) / (area_m2 / 1e4), 2) AS npv_ha, round({KW} * (capex + b) / (area_m2 / 1e4), 2) AS cost_ha
        FROM pixels, f JOIN k ON f.scenario = k.scenario""",
)
def e16(t):
    years = list(range(2020, 2031))
    ids = ["scenario"]
    known = t.scen_long.where("variable = 'om' and analysis_year <= 2030").groupBy("scenario").agg(F.count("value").alias("k")).where("k = 2").select("scenario")
    line = lambda v: T.interp_series(t.scen_long.where(f"variable = '{v}' and analysis_year <= 2030").join(known, ids, "left_semi"), ids, "analysis_year", "value", years).select("scenario", F.col("analysis_year").alias("year"), F.col("value").alias(v))
    factors = T.scenario_factors(line("price").join(line("om"), ["scenario", "year"]), ids, [2030])
    capital = t.scen_long.where("variable = 'capital' and analysis_year = 2020").select("scenario", F.col("value").alias("capex"))
    pixels = t.pixels.withColumn("kwh", F.col("rsds") * F.col("area_m2"))
    return rounded(T.npv_pv(pixels, factors, capital, ids).select("pixel_id", "scenario", "npv_ha", "cost_ha"), "pixel_id", "scenario", places=2)


LINES = """SELECT scenario, variable, yr, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR hy = ly THEN lo ELSE lo + (hi - lo) * (yr - ly) / (hy - ly) END AS v
    FROM (SELECT scenario, variable, yr, max_by(value, analysis_year) FILTER (analysis_year <= yr) AS lo, max(analysis_year) FILTER (analysis_year <= yr) AS ly,
                 min_by(value, analysis_year) FILTER (analysis_year >= yr) AS hi, min(analysis_year) FILTER (analysis_year >= yr) AS hy
          FROM scen_long, range(2021, 2051) r(yr) WHERE value IS NOT NULL AND variable IN ('price', 'om') GROUP BY 1, 2, 3) k"""
TARGETS = [2020, 2030, 2040, 2050]


@query(
    "e16_npv_pv_all_targets",
    "pixels states scen_long demand",
    f"""WITH l AS ({LINES}),
        y AS (SELECT p.scenario, p.yr, p.v / pow(1.05e0, p.yr - 2020) / 277.778e0 AS a, m.v / pow(1.05e0, p.yr - 2020) AS b FROM l p JOIN l m ON p.scenario = m.scenario AND p.yr = m.yr WHERE p.variable = 'price' AND m.variable = 'om'),
        d AS (SELECT state, year, sum(mmbtu) AS e FROM demand WHERE scenario = 'MID' AND final_energy = 'ELECTRICITY' AND year BETWEEN 2020 AND 2050 GROUP BY 1, 2),
        q AS (SELECT s.state_key, d.year, greatest(0.7e0, least(1.3e0, pow(e / median(e) OVER (PARTITION BY d.year), 0.3e0))) AS ratio FROM d JOIN states s ON s.name = d.state),
        z AS (SELECT s.state_key, y.scenario, t.target, coalesce(sum(y.a) FILTER (y.yr <= t.target), 0) AS a, coalesce(sum(y.b) FILTER (y.yr <= t.target), 0) AS b,
                     coalesce(sum(y.a * coalesce(ratio, 1)) FILTER (y.yr <= t.target), 0) AS aa, coalesce(sum(y.b * coalesce(ratio, 1)) FILTER (y.yr <= t.target), 0) AS ba
              FROM states s CROSS JOIN y CROSS JOIN (SELECT unnest({TARGETS}) AS target) t LEFT JOIN q ON q.state_key = s.state_key AND q.year = y.yr GROUP BY 1, 2, 3),
        k AS (SELECT scenario, value AS capex FROM scen_long WHERE variable = 'capital' AND analysis_year = 2020 AND value IS NOT NULL)
        SELECT p.state_key, z.scenario, z.target, count(*) AS cells, round(avg(({{v}}) / (area_m2 / 1e4)), 2) AS npv_ha, round(avg({KW} * (capex + b) / (area_m2 / 1e4)), 2) AS cost_ha, round(avg(({{w}}) / (area_m2 / 1e4)), 2) AS npv_adj_ha
        FROM pixels p JOIN z ON p.state_key = z.state_key JOIN k ON k.scenario = z.scenario GROUP BY 1, 2, 3""".replace("{v}", f"rsds * area_m2 * a - {KW} * (capex + b)").replace("{w}", f"rsds * area_m2 * aa - {KW} * (capex + ba)"),
)
def e16b(t):
    years, ids = list(range(2020, 2051)), ["scenario"]
    line = lambda v: T.interp_series(t.scen_long.where(f"variable = '{v}'"), ids, "analysis_year", "value", years).select("scenario", F.col("analysis_year").alias("year"), F.col("value").alias(v))
    yearly = line("price").join(line("om"), ["scenario", "year"])
    energy = t.demand.where("scenario = 'MID' and final_energy = 'ELECTRICITY' and year between 2020 and 2050").groupBy("state", "year").agg(F.sum("mmbtu").alias("e"))
    ratios = T.demand_ratio(energy, ["year"], "e").join(t.states.select("state_key", F.col("name").alias("state")), "state").select("state_key", "year", "ratio")
    capital = t.scen_long.where("variable = 'capital' and analysis_year = 2020 and value is not null").select("scenario", F.col("value").alias("capex"))
    pixels = t.pixels.withColumn("kwh", F.col("rsds") * F.col("area_m2"))
    found = T.npv_pv_adjusted(pixels, T.scenario_factors(yearly, ids, TARGETS), T.adjusted_factors(yearly, ratios, ids, "state_key", TARGETS), capital, ids, "state_key")
    out = found.groupBy("state_key", "scenario", "target").agg(F.count("*").alias("cells"), *[F.avg(c).alias(c) for c in ("npv_ha", "cost_ha", "npv_adj_ha")])
    return rounded(out, "state_key", "scenario", "target", places=2)


YIELDS = " UNION ALL ".join(f"SELECT pixel_id, '{c.split('_')[0]}' AS crop, coalesce({c}, 0e0){' * 10' if '10kg' in c else ''} AS kg FROM crops" for c in ("maize_rcp26_kg_dw_ha", "wheat_rcp26_10kg_dw_ha", "soybean_rcp26_kg_dw_ha"))
SERIES = "SELECT v.item, v.scenario, v.year, v.value / w.value * 1000 AS price FROM crop_price v JOIN crop_price w ON v.item = w.item AND v.scenario = w.scenario AND v.year = w.year WHERE v.element = 'value' AND w.element = 'tonnes' AND w.value > 0"


@query(
    "e17_npv_crop",
    "crops crop_price",
    f"""WITH p AS (SELECT item AS crop, scenario, year, price FROM ({SERIES}) s WHERE year > 2020),
        r AS (SELECT pixel_id, scenario, year, sum(kg * price / 1000 * (kg * price / 1000)) / sum(kg * price / 1000) AS rev FROM ({YIELDS}) y JOIN p ON y.crop = p.crop WHERE kg > 0 GROUP BY 1, 2, 3)
        SELECT c.pixel_id, z.scenario, CAST(t AS INT) AS target, round(coalesce(sum(rev * 0.2e0 / pow(1.05e0, year - 2020)) FILTER (year <= t), 0) - 4340e0, 2) AS npv_ha
        FROM crops c CROSS JOIN (SELECT scenario, unnest([2020, 2030, 2040, 2050]) AS t FROM (SELECT DISTINCT scenario FROM crop_price) d) z
        LEFT JOIN r ON c.pixel_id = r.pixel_id AND z.scenario = r.scenario GROUP BY 1, 2, 3""",
)
def e17(t):
    names = [c for c in t.crops.columns if c.endswith("dw_ha")]
    long = t.crops.unpivot("pixel_id", names, "name", "v")
    yields = long.select("pixel_id", S.crop_of_column(F.col("name")).alias("crop"), S.yield_kg(F.col("v"), F.col("name")).alias("kg"))
    prices = T.crop_price_series(t.crop_price).select(F.col("item").alias("crop"), "scenario", "year", "price")
    return rounded(T.npv_crop(yields, prices, "pixel_id", [2020, 2030, 2040, 2050], "scenario"), "pixel_id", "scenario", "target", places=2)


@query(
    "e18_npv_forest",
    "alts pixels",
    "SELECT a.pixel_id, rcp_category, analysis_year, round(-cost_usd + CASE WHEN analysis_year - 2020 >= 30 THEN least(60e0 + carbon, prob * 30) * 0.4e0 * 150e0 / pow(1.05e0, 30) ELSE 0e0 END, 4) AS npv FROM alts a JOIN pixels p ON a.pixel_id = p.pixel_id",
)
def e18(t):
    growth = t.pixels.select("pixel_id", (60.0 + F.col("carbon")).alias("pot_agb"), F.col("prob").alias("sequestration"))
    df = t.alts.join(growth.hint("shuffle_hash"), "pixel_id").withColumnRenamed("cost_usd", "cost")  # a task holds its cells once, not sorted rows by scenario and year
    return df.select("pixel_id", "rcp_category", "analysis_year", r4(T.npv_forest(df, F.col("analysis_year"), 0.4, 150.0)).alias("npv"))


@query("e19_npv_natural", "alts", "SELECT pixel_id, rcp_category, analysis_year, round(-cost_usd, 4) AS npv FROM alts")
def e19(t):
    return t.alts.select("pixel_id", "rcp_category", "analysis_year", r4(T.npv_natural(F.col("cost_usd"))).alias("npv"))


@query(
    "e20_net_expected_benefit",
    "npv alts",
    """SELECT n.pixel_id, n.model_id, n.scenario_id, n.analysis_year, round(npv_usd - (w_agri * g + w_forest * f + w_natural * u), 4) AS net
       FROM npv n JOIN (SELECT pixel_id, analysis_year, avg(npv_agri) AS g, avg(npv_forest) AS f, avg(npv_natural) AS u, max(w_agri) AS w_agri, max(w_forest) AS w_forest, max(w_natural) AS w_natural FROM alts GROUP BY 1, 2) m
       ON n.pixel_id = m.pixel_id AND n.analysis_year = m.analysis_year""",
)
def e20(t):
    weights = t.alts.groupBy("pixel_id").agg(*[F.max(f"w_{n}").alias(f"w_{n}") for n in ("agri", "forest", "natural")])
    return T.net_expected_benefit(t.npv, t.alts, weights, "pixel_id").select("pixel_id", "model_id", "scenario_id", "analysis_year", r4("net").alias("net"))


@query(
    "e21_demand_adjust_ratio",
    "demand",
    """SELECT state, scenario, sector, year, round(least(greatest(pow(mmbtu / m, 0.3e0), 0.7e0), 1.3e0), 6) AS ratio
       FROM demand JOIN (SELECT scenario AS sc, year AS yr, median(mmbtu) AS m FROM demand GROUP BY 1, 2) z ON scenario = sc AND year = yr""",
)
def e21(t):
    return T.demand_ratio(t.demand, ["scenario", "year"], "mmbtu").select("state", "scenario", "sector", "year", r4("ratio", 6).alias("ratio"))


@query("e22_crop_price_series", "crop_price", f"SELECT item, scenario, year, round(price, 4) AS price FROM ({SERIES}) s")
def e22(t):
    return rounded(T.crop_price_series(t.crop_price), "item", "scenario", "year")


DECILE = " + ".join(f"CAST(npv > q[{i}] AS INT)" for i in range(1, 10))


@query(
    "e23_quantile_groups",
    "pixels",
    f"""SELECT pixel_id, CASE WHEN c < 3 THEN 'Low' WHEN c < 7 THEN 'Mid' ELSE 'High' END AS grp
        FROM (SELECT pixel_id, {DECILE} AS c FROM pixels, (SELECT quantile_cont(npv, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM pixels) z) x""",
)
def e23(t):
    return A.quantile_groups(t.pixels, "npv").select("pixel_id", "grp")


PCT = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0) / count(*) OVER () * 100"


@query(
    "e24_priority_rank",
    "pixels",
    f"""SELECT pixel_id, round(a, 4) AS pr_prob, round(b, 4) AS pr_carbon, round(c, 4) AS pr_npv, concat_ws('+', CASE WHEN a >= 70 THEN 'prob' END, CASE WHEN b >= 70 THEN 'carbon' END, CASE WHEN c >= 70 THEN 'npv' END) AS label
        FROM (SELECT pixel_id, {PCT.format(c='prob')} AS a, {PCT.format(c='carbon')} AS b, {PCT.format(c='npv')} AS c FROM pixels) x""",
)
def e24(t):
    df = R.priority_rank(t.pixels.select("pixel_id", *METRICS), METRICS)
    return df.select("pixel_id", *[r4(f"pr_{m}").alias(f"pr_{m}") for m in METRICS], "label")


@query(
    "e25_pit",
    "pixels",
    "SELECT pixel_id, round((SELECT count(*) FROM pixels r WHERE r.pixel_id % 10 = 0 AND r.prob <= p.prob) / (SELECT count(*) FROM pixels WHERE pixel_id % 10 = 0), 6) AS pit FROM pixels p WHERE pixel_id % 10 <> 0",
)
def e25(t):
    pool = t.pixels.where("pixel_id % 10 <> 0").select("pixel_id", "prob")
    return R.pit(t.pixels.where("pixel_id % 10 = 0"), pool, "prob").select("pixel_id", r4("pit", 6).alias("pit"))


W = "CASE '{k}' WHEN 'decreasing' THEN (1 - (k - 0.5e0) / n) / n WHEN 'increasing' THEN (k - 0.5e0) / n / n ELSE exp(-pow((k - 0.5e0) / n - 0.5e0, 2) / (2 * 0.15e0 * 0.15e0)) / sum(exp(-pow((k - 0.5e0) / n - 0.5e0, 2) / (2 * 0.15e0 * 0.15e0))) OVER () * n * 0.5e0 END"


@query("e26_kernel_weights", "pixels", " UNION ALL ".join(f"SELECT '{k}' AS kind, k AS rank, round({W.format(k=k)}, 8) AS w FROM ({RANKED.format(o='npv')}) r" for k in ("decreasing", "increasing", "gaussian")))
def e26(t):
    ranked = R.ranked_prefix(t.pixels, "npv", "pixel_id", []).select("rank", "n")
    one = lambda k: R.with_kernel(ranked, k).select(F.lit(k).alias("kind"), F.col("rank").cast("long").alias("rank"), r4("w", 8).alias("w"))
    return one("decreasing").union(one("increasing")).union(one("gaussian"))


@query("e27_kernel_efficiency", "pixels", f"SELECT round(sum(prob * w), 6) AS prob, round(sum(carbon * w), 6) AS carbon FROM (SELECT *, {W.format(k='decreasing')} AS w FROM ({RANKED.format(o='npv')}) r) x")
def e27(t):
    return rounded(R.kernel_efficiency(t.pixels, "npv", ["prob", "carbon"], "pixel_id"), places=6)


@query(
    "e28_policy_permutation",
    "pixels",
    """SELECT r.pixel_id, p.position FROM (SELECT pixel_id, row_number() OVER (ORDER BY npv DESC, pixel_id) AS k FROM pixels) r
       JOIN (SELECT k AS position, row_number() OVER (ORDER BY abs(2 * k - 1 - n), k) AS o FROM (SELECT row_number() OVER (ORDER BY npv DESC, pixel_id) AS k, count(*) OVER () AS n FROM pixels) b) p ON r.k = p.o""",
)
def e28(t):
    return R.policy_permutation(t.pixels, "npv", "pixel_id", "gaussian").select("pixel_id", F.col("position").cast("long").alias("position"))


@query("e28_increasing", "pixels", "SELECT pixel_id, count(*) OVER () + 1 - row_number() OVER (ORDER BY npv DESC, pixel_id) AS position FROM pixels")
def e28b(t):
    return R.policy_permutation(t.pixels, "npv", "pixel_id", "increasing").select("pixel_id", F.col("position").cast("long").alias("position"))


@query(
    "e29_topk",
    "pixels",
    "SELECT 'top' AS side, * FROM (SELECT pixel_id, round(npv, 4) AS npv FROM pixels ORDER BY npv DESC, pixel_id LIMIT 10) a UNION ALL SELECT 'bottom', * FROM (SELECT pixel_id, round(npv, 4) FROM pixels ORDER BY npv, pixel_id LIMIT 10) b",
)
def e29(t):
    one = lambda side, big: R.topk(t.pixels, "npv", "pixel_id", 10, big).select(F.lit(side).alias("side"), "pixel_id", r4("npv").alias("npv"))
    return one("top", True).union(one("bottom", False))


@query("e29_extremes", "pixels", "SELECT (SELECT pixel_id FROM pixels ORDER BY npv DESC, pixel_id LIMIT 1) AS argmax, (SELECT pixel_id FROM pixels ORDER BY npv, pixel_id LIMIT 1) AS argmin")
def e29b(t):
    return R.extremes(t.pixels, "npv", "pixel_id")


@query("e30_within_between", "pixels", "SELECT pixel_id, round(avg(npv) OVER w, 4) AS npv_between, round(npv - avg(npv) OVER w, 4) AS npv_within FROM pixels WINDOW w AS (PARTITION BY state_key)")
def e30(t):
    return R.within_between(t.pixels, "state_key", ["npv"]).select("pixel_id", r4("npv_between").alias("npv_between"), r4("npv_within").alias("npv_within"))


OFF_HALF = 0.0137  # sums of means of cents are often just halves, which the last bit of a sum would round either way


@query(
    "e31_cumulative_policy_paths",
    "npv",
    f"""SELECT pixel_id, row_number() OVER w AS rank, {', '.join(f'round(sum({p}) OVER (w ROWS UNBOUNDED PRECEDING) + {OFF_HALF}, 0) AS cum_{p}' for p in ('P1', 'P2', 'P3', 'total'))}
        FROM (SELECT *, P1 + P2 + P3 AS total FROM (SELECT pixel_id, {', '.join(f"coalesce(avg(npv_usd) FILTER ({POLICY} = '{p}'), 0e0) AS {p}" for p in ('P1', 'P2', 'P3'))} FROM npv GROUP BY 1) a) b WINDOW w AS (ORDER BY total DESC, pixel_id)""",
)
def e31(t):
    df = R.policy_paths(t.npv, "pixel_id", S.policy_group(F.col("policy_category")), "npv_usd", ["P1", "P2", "P3"])
    sums = {f"cum_{p}": F.col(f"cum_{p}") + OFF_HALF for p in ("P1", "P2", "P3", "total")}
    return rounded(df.withColumns({"rank": F.col("rank").cast("long"), **sums}), "pixel_id", "rank", places=0)


@query(
    "e32_kernel_cumulative_curves",
    "pixels",
    """SELECT position, round(position / n * 100, 6) AS pct, round(sum(carbon) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING), 2) AS cumulative
       FROM (SELECT carbon, count(*) OVER () + 1 - row_number() OVER (ORDER BY npv DESC, pixel_id) AS position, count(*) OVER () AS n FROM pixels) x""",
)
def e32(t):
    df = R.kernel_curve(t.pixels, "npv", "carbon", "pixel_id", "increasing")
    return df.select(F.col("position").cast("long").alias("position"), r4("pct", 6).alias("pct"), r4("cumulative", 2).alias("cumulative"))

