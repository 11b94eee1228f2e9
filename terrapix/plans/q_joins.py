"""Queries of the joins, spatial operators and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r4
from ..operators import joins as J
from ..operators import spatial as G
from .q_aggregates import STATE, polygons, rounded
from .registry import query

KEYS = ["lat_idx", "lon_idx"]


@query(
    "c1_join_cells",
    "pixels crops lc_series",
    "SELECT lat_idx, lon_idx, round(p.npv, 4) AS npv, c.jatropha_class, l.code FROM pixels p JOIN crops c USING (lat_idx, lon_idx) JOIN (SELECT * FROM lc_series WHERE year = 2010) l USING (lat_idx, lon_idx)",
)
def c1(t):
    pixels = t.pixels.select(*KEYS, r4("npv").alias("npv"))  # rounded here, once a row and not once a match
    return J.join_gathered([pixels, t.crops.select(*KEYS, "jatropha_class"), t.lc_series.where("year = 2010").select(*KEYS, "code")], KEYS)


@query(
    "c2_outer_cells",
    "pixels sites",
    "SELECT lat_idx, lon_idx, pixel_id, n FROM pixels FULL JOIN (SELECT lat_idx, lon_idx, count(*) AS n FROM sites GROUP BY 1, 2) s USING (lat_idx, lon_idx)",
)
def c2(t):
    return J.outer_cells([t.pixels.select(*KEYS, "pixel_id"), t.sites.groupBy(*KEYS).agg(F.count("*").alias("n"))], KEYS)


@query("c3_left_enrich", "pixels states", "SELECT pixel_id, name FROM pixels LEFT JOIN (SELECT * FROM states WHERE state_key < 20) s USING (state_key)")
def c3(t):
    return J.left_enrich(t.pixels, t.states.where("state_key < 20"), ["state_key"]).select("pixel_id", "name")


@query("c4_anti_cells", "pixels sites", "SELECT pixel_id FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.lat_idx = p.lat_idx AND s.lon_idx = p.lon_idx)")
def c4(t):
    return J.anti_cells(t.pixels, t.sites, KEYS).select("pixel_id")


@query("c5_semi_axis", "pixels sites", "SELECT pixel_id FROM pixels WHERE lat_idx IN (SELECT lat_idx FROM sites WHERE unique_id < 150) AND lon_idx IN (SELECT lon_idx FROM sites WHERE unique_id < 150)")
def c5(t):
    return J.semi_axis(t.pixels, t.sites.where("unique_id < 150"), KEYS).select("pixel_id")


@query("c6_clip_points", "pixels states", f"SELECT pixel_id FROM pixels {STATE} WHERE s.state_key % 2 = 0")
def c6(t):
    return G.clip_points(t.pixels, polygons(t).where("state_key % 2 = 0"), "pixel_id").select("pixel_id")


@query("c7_label_points", "pixels states", "SELECT pixel_id, upper(name) AS name FROM pixels LEFT JOIN (SELECT * FROM states WHERE state_key <> 7) s ON lat > lat_lo AND lat < lat_hi AND lon > lon_lo AND lon < lon_hi")
def c7(t):
    return G.label_points(t.pixels, polygons(t).where("state_key <> 7"), "pixel_id", "name").select("pixel_id", "name")


@query(
    "c8_aggregate_in_polygons",
    "sites states",
    "SELECT lower(name) AS name, count(unique_id) AS n, round(coalesce(sum(p_area), 0), 2) AS total FROM states LEFT JOIN sites ON lat > lat_lo AND lat < lat_hi AND lon > lon_lo AND lon < lon_hi GROUP BY 1",
)
def c8(t):
    return rounded(G.aggregate_in_polygons(t.sites, polygons(t), "name", "p_area"), "name", places=2)


MOVED = "SELECT unique_id, lat + 1e-2 * ((unique_id * 7) % 5 - 2) AS lat, lon + 2e-2 * ((unique_id * 3) % 5 - 2) AS lon FROM sites"


def _moved(t):
    return t.spark.sql(MOVED.replace("FROM sites", "FROM {sites}"), sites=t.sites)


@query("c9_snap_to_grid", "sites", f"SELECT unique_id, round(25e0 + round_even((lat - 25e0) / 0.06e0, 0) * 0.06e0, 6) AS lat, round(-125e0 + round_even((lon + 125e0) / 0.15e0, 0) * 0.15e0, 6) AS lon FROM ({MOVED}) m")
def c9(t):
    return _moved(t).select("unique_id", r4(G.snap_to_grid(F.col("lat"), 25.0, 0.06), 6).alias("lat"), r4(G.snap_to_grid(F.col("lon"), -125.0, 0.15), 6).alias("lon"))


@query(
    "c10_snap_nearest_trim",
    "sites",
    f"""SELECT unique_id, round(sa, 6) AS snap_lat, round(so, 6) AS snap_lon FROM (SELECT *, 25e0 + round_even((lat - 25e0) / 0.06e0, 0) * 0.06e0 AS sa, -125e0 + round_even((lon + 125e0) / 0.06e0, 0) * 0.06e0 AS so FROM ({MOVED}) m) x
        WHERE abs(lat - sa) <= 0.015e0 AND abs(lon - so) <= 0.015e0""",
)
def c10(t):
    return G.snap_nearest_trim(_moved(t), 25.0, -125.0, 0.06, 0.015).select("unique_id", r4("snap_lat", 6).alias("snap_lat"), r4("snap_lon", 6).alias("snap_lon"))


NEAR = "(SELECT t.{k}, s.{v} FROM {t} t, {s} s QUALIFY row_number() OVER (PARTITION BY t.{k} ORDER BY (t.lon - s.lon) * (t.lon - s.lon) + (t.lat - s.lat) * (t.lat - s.lat), s.{o}) = 1)"


@query(
    "c11_fill_nonpositive_nearest",
    "sites",
    f"""SELECT unique_id, capacity_m FROM sites WHERE capacity_m > 0 UNION ALL
        SELECT unique_id, capacity_m FROM {NEAR.format(k='unique_id', v='capacity_m', t='(SELECT * FROM sites WHERE NOT capacity_m > 0)', s='(SELECT * FROM sites WHERE capacity_m > 0)', o='unique_id')} n""",
)
def c11(t):
    return G.fill_nonpositive_nearest(t.sites, ["capacity_m"], "unique_id").select("unique_id", "capacity_m")


@query(
    "c12_nearest_valid_sample",
    "sites pixels",
    f"SELECT unique_id, prob FROM {NEAR.format(k='unique_id', v='prob', t='sites', s='(SELECT * FROM pixels WHERE pixel_id % 5 <> 0)', o='pixel_id')} n",
)
def c12(t):
    grid = t.pixels.withColumn("prob", F.when(F.col("pixel_id") % 5 != 0, F.col("prob")))
    return G.nearest_valid_sample(t.sites.select("unique_id", "lat", "lon"), grid, ["prob"], "unique_id", "pixel_id").select("unique_id", "prob")


@query(
    "c13_idw_join",
    "sites pixels",
    """SELECT unique_id, round(sum(npv / pow(greatest(sqrt(d), 1e-10), 2)) / sum(1 / pow(greatest(sqrt(d), 1e-10), 2)), 4) AS npv
       FROM (SELECT unique_id, npv, (t.lon - s.lon) * (t.lon - s.lon) + (t.lat - s.lat) * (t.lat - s.lat) AS d FROM sites t, pixels s
             QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY (t.lon - s.lon) * (t.lon - s.lon) + (t.lat - s.lat) * (t.lat - s.lat), s.pixel_id) <= 10) x GROUP BY 1""",
)
def c13(t):
    return rounded(G.idw_join(t.sites.select("unique_id", "lat", "lon"), t.pixels, ["npv"], "unique_id", "pixel_id"), "unique_id")


@query(
    "c14_sample_nearest",
    "sites pixels",
    f"""SELECT unique_id, round(npv, 4) AS sampled FROM ({MOVED}) m LEFT JOIN pixels p ON p.lat_idx = CAST(round_even((m.lat - 25e0) / 0.06e0, 0) AS BIGINT) AND p.lon_idx = CAST(round_even((m.lon + 125e0) / 0.15e0, 0) AS BIGINT)""",
)
def c14(t):
    return G.sample_grid(_moved(t), t.pixels, "npv", 25.0, -125.0, 0.06, 0.15).select("unique_id", r4("sampled").alias("sampled"))


GRID = "SELECT CAST(a AS BIGINT) AS lat_idx, CAST(b AS BIGINT) AS lon_idx, CAST((a * 31 + b * 17) % 101 AS DOUBLE) AS v FROM (SELECT DISTINCT lat_idx % 40 AS a FROM pixels) x, (SELECT DISTINCT lon_idx % 40 AS b FROM pixels) y"


def _grid(t):
    axis = lambda c, n: t.pixels.select((F.col(c) % 40).alias(n)).distinct()
    return axis("lat_idx", "lat_idx").crossJoin(axis("lon_idx", "lon_idx")).withColumn("v", ((F.col("lat_idx") * 31 + F.col("lon_idx") * 17) % 101).cast("double"))


@query(
    "c14_sample_bilinear",
    "pixels",
    f"""WITH g AS ({GRID}), q AS (SELECT pixel_id, (lat - 25e0) / 0.625e0 AS fy, (lon + 125e0) / 1.5625e0 AS fx FROM pixels),
        r AS (SELECT *, floor(fy + 1e-9) AS iy, floor(fx + 1e-9) AS ix, greatest(fy - floor(fy + 1e-9), 0e0) AS wy, greatest(fx - floor(fx + 1e-9), 0e0) AS wx FROM q)
        SELECT pixel_id, round(a.v * (1 - wy) * (1 - wx) + b.v * (1 - wy) * wx + c.v * wy * (1 - wx) + d.v * wy * wx, 6) AS sampled FROM r
        LEFT JOIN g a ON a.lat_idx = iy AND a.lon_idx = ix LEFT JOIN g b ON b.lat_idx = iy AND b.lon_idx = ix + 1
        LEFT JOIN g c ON c.lat_idx = iy + 1 AND c.lon_idx = ix LEFT JOIN g d ON d.lat_idx = iy + 1 AND d.lon_idx = ix + 1""",
)
def c14b(t):
    return G.sample_grid(t.pixels.select("pixel_id", "lat", "lon"), _grid(t), "v", 25.0, -125.0, 0.625, 1.5625, "bilinear").select("pixel_id", r4("sampled", 6).alias("sampled"))


@query(
    "c15_resample_grid",
    "pixels",
    f"""WITH g AS ({GRID}) SELECT pixel_id, v AS sampled FROM (SELECT * FROM pixels WHERE landcover <= 3) p LEFT JOIN g ON g.lat_idx = CAST(round_even((lat - 25e0) / 0.625e0, 0) AS BIGINT) AND g.lon_idx = CAST(round_even((lon + 125e0) / 1.5625e0, 0) AS BIGINT)""",
)
def c15(t):
    land = t.pixels.where("landcover <= 3")
    return G.resample_grid(_grid(t), t.pixels.select("pixel_id", "lat", "lon"), "v", 25.0, -125.0, 0.625, 1.5625, mask=land).select("pixel_id", "sampled")


XY = "6371000e0 * radians({a}.lon), 6371000e0 * sin(radians({a}.lat))"
FAR2 = "pow(6371000e0 * (radians(p.lon) - radians(s.lon)), 2) + pow(6371000e0 * (sin(radians(p.lat)) - sin(radians(s.lat))), 2)"


@query("c16_distance_to_features", "pixels sites", f"SELECT pixel_id, round(sqrt(min({FAR2})), 2) AS metres FROM pixels p, sites s GROUP BY 1")
def c16(t):
    return rounded(G.distance_to_features(t.pixels, t.sites, "pixel_id", "unique_id"), "pixel_id", places=2)


@query(
    "c16_distance_to_lines",
    "pixels sites",
    """WITH l AS (SELECT 6371000e0 * radians(lon) AS ax, 6371000e0 * sin(radians(lat)) AS ay, 6371000e0 * radians(lon + 0.8e0) AS zx, 6371000e0 * sin(radians(lat + 0.6e0)) AS zy FROM sites),
            v AS (SELECT ax, ay, zx - ax AS dx, zy - ay AS dy FROM l),
            q AS (SELECT pixel_id, 6371000e0 * radians(lon) AS px, 6371000e0 * sin(radians(lat)) AS py FROM pixels),
            t AS (SELECT pixel_id, px - ax AS ex, py - ay AS ey, dx, dy, greatest(0e0, least(1e0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM q, v)
        SELECT pixel_id, round(sqrt(min(pow(ex - t * dx, 2) + pow(ey - t * dy, 2))), 2) AS metres FROM t GROUP BY 1""",
)
def c16b(t):
    ends = [F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + 0.8).alias("x2"), (F.col("lat") + 0.6).alias("y2")]
    lines = t.sites.select(F.col("unique_id").alias("line_id"), *ends)
    return rounded(G.distance_to_lines(t.pixels, lines, "pixel_id", "line_id").drop("line_id"), "pixel_id", places=2)


@query("c17_polygon_mask", "pixels states", f"SELECT pixel_id, s.state_key IN (1, 2, 12) AS masked FROM pixels {STATE}")
def c17(t):
    p = polygons(t)
    return G.polygon_mask(t.pixels, [p.where("state_key in (1, 2)"), p.where("state_key = 12")], "pixel_id").select("pixel_id", "masked")


@query(
    "c18_scenario_cross",
    "intensity",
    "SELECT scenario, year, a AS availability, CAST(e AS DOUBLE) / 100 AS efficiency FROM intensity, (SELECT unnest([60, 70, 80, 90, 100]) AS a) x, (SELECT unnest([15, 17, 19, 21]) AS e) y",
)
def c18(t):
    a = t.spark.createDataFrame([(x,) for x in (60, 70, 80, 90, 100)], "availability int")
    e = t.spark.createDataFrame([(x / 100,) for x in (15, 17, 19, 21)], "efficiency double")
    return J.scenario_cross(t.intensity.select("scenario", "year"), a, e)


@query(
    "c19_pixel_scenario_year_cross",
    "pixels scen_long",
    "SELECT state_key, scenario, analysis_year, count(*) AS n FROM (SELECT pixel_id, state_key FROM pixels) p, (SELECT DISTINCT scenario, analysis_year FROM scen_long) s GROUP BY 1, 2, 3",
)
def c19(t):
    crossed = J.scenario_cross(t.pixels.select("pixel_id", "state_key"), t.scen_long.select("scenario", "analysis_year").distinct())
    return crossed.groupBy("state_key", "scenario", "analysis_year").agg(F.count("*").alias("n"))


@query(
    "c20_common_scenarios",
    "demand scen_long",
    """SELECT d.scenario, final_energy FROM (SELECT scenario FROM demand WHERE final_energy = 'ELECTRICITY' OR scenario IN ('LOW', 'MID') GROUP BY 1 HAVING count(DISTINCT state) = 25) d
       JOIN (SELECT DISTINCT scenario, 'x' AS final_energy FROM demand) m ON d.scenario = m.scenario""",
)
def c20(t):
    rows = t.demand.where("final_energy = 'ELECTRICITY' or scenario in ('LOW', 'MID')")
    meta = t.demand.select("scenario").distinct().withColumn("final_energy", F.lit("x"))
    return J.common_scenarios(rows, "state", ["scenario"], meta)


@query(
    "c21_availability",
    "scen_long",
    """SELECT model, scenario, om, CASE WHEN om THEN 'complete' ELSE 'no_om' END AS pattern FROM (SELECT model, scenario, count(value) FILTER (variable = 'price') >= 4 AS price, count(value) FILTER (variable = 'capital') >= 4 AS capital,
       count(value) FILTER (variable = 'om') >= 4 AS om FROM scen_long GROUP BY 1, 2) x WHERE price AND capital""",
)
def c21(t):
    return J.availability(t.scen_long, ["model", "scenario"])


@query(
    "c22_fill_om_regional_mean",
    "scen_long",
    """SELECT model, scenario, analysis_year, round(CASE WHEN whole THEN value ELSE coalesce(mean, 50e0) END, 4) AS om, CASE WHEN whole THEN 'own' WHEN mean IS NOT NULL THEN 'regional_mean' ELSE 'default' END AS source
       FROM (SELECT *, count(value) OVER (PARTITION BY model, scenario) = count(*) OVER (PARTITION BY model, scenario) AS whole, avg(value) OVER (PARTITION BY model, analysis_year) AS mean FROM scen_long WHERE variable = 'om') x""",
)
def c22(t):
    return rounded(J.fill_om_regional_mean(t.scen_long, ["model", "scenario"], "model"), "model", "scenario", "analysis_year")


@query(
    "c23_map_state_ratio",
    "demand states",
    """SELECT s.name, coalesce(l.r, 1e0) AS "LOW", coalesce(h.r, 1e0) AS "HIGH" FROM states s LEFT JOIN (SELECT state, max(round(mmbtu / 1e3, 4)) AS r FROM demand WHERE year = 2020 AND scenario = 'LOW' AND final_energy = 'FUEL' GROUP BY 1) l ON s.name = l.state
       LEFT JOIN (SELECT state, max(round(mmbtu / 1e3, 4)) AS r FROM demand WHERE year = 2020 AND scenario = 'HIGH' AND final_energy = 'FUEL' GROUP BY 1) h ON s.name = h.state""",
)
def c23(t):
    ratios = t.demand.where("year = 2020 and final_energy = 'FUEL'").groupBy("state", "scenario").agg(F.max(F.round(F.col("mmbtu") / 1e3, 4)).alias("ratio"))
    return J.map_state_ratio(t.states.select(F.col("name").alias("state")), ratios, "state", ["LOW", "HIGH"]).withColumnRenamed("state", "name")


@query(
    "c24_crop_lookup",
    "crops crop_price",
    "SELECT crop, item, count(*) AS n, sum(v) AS v FROM (SELECT 'maize' AS crop, maize_rcp26_kg_dw_ha AS v FROM crops UNION ALL SELECT 'jatropha', jatropha_class FROM crops) u JOIN (SELECT DISTINCT item FROM crop_price) p ON item = crop GROUP BY 1, 2",
)
def c24(t):
    long = t.crops.select(F.col("maize_rcp26_kg_dw_ha").alias("maize"), F.col("jatropha_class").alias("jatropha")).unpivot([], ["maize", "jatropha"], "crop", "v")
    return J.crop_lookup(long, t.crop_price, F.lower("crop")).groupBy("crop", "item").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("c25_climate_zone", "pixels states", "SELECT pixel_id, CAST(state_key % 7 AS INT) AS zone, CASE WHEN state_key % 7 < 3 THEN 'A' WHEN state_key % 7 < 6 THEN 'B' END AS merged FROM pixels")
def c25(t):
    first = t.states.select("state_key", (F.col("state_key") % 7).cast("int").alias("zone"))
    second = first.select("zone").distinct().where("zone < 6").withColumn("merged", F.when(F.col("zone") < 3, "A").otherwise("B"))
    return J.two_step_map(t.pixels.select("pixel_id", "state_key"), "state_key", first, second).select("pixel_id", "zone", "merged")


@query(
    "c26_opportunity_by_rcp",
    "npv alts",
    """SELECT n.category, a.rcp_category, count(*) AS n, round(sum(npv_usd - npv_agri - npv_forest - npv_natural), 2) AS net FROM npv n JOIN alts a ON n.pixel_id = a.pixel_id AND n.analysis_year = a.analysis_year
       AND a.rcp_category = CASE WHEN category IN ('C1', 'C2', 'C3') THEN 'RCP2.6' WHEN category = 'C4' THEN 'RCP4.5' WHEN category = 'C5' THEN 'RCP6.0' ELSE 'RCP8.5' END GROUP BY 1, 2""",
)
def c26(t):
    from ..operators.scalar import rcp_of_category

    parts = [t.alts.select("pixel_id", "analysis_year", "rcp_category", f"npv_{n}") for n in ("agri", "forest", "natural")]
    costs = J.join_cells(parts, ["pixel_id", "analysis_year", "rcp_category"])
    df = t.npv.withColumn("rcp_category", rcp_of_category(F.col("category"))).join(costs, ["pixel_id", "analysis_year", "rcp_category"])
    return df.groupBy("category", "rcp_category").agg(F.count("*").alias("n"), r4(F.sum(F.col("npv_usd") - F.col("npv_agri") - F.col("npv_forest") - F.col("npv_natural")), 2).alias("net"))


@query(
    "c27_ring_fill",
    "pixels",
    """WITH h AS (SELECT DISTINCT lat_idx % 60 AS q, lon_idx % 60 AS r FROM pixels), g AS (SELECT q, r, CASE WHEN (q * 7 + r * 13) % 5 = 0 THEN NULL ELSE q * 100 + r END AS v FROM h)
       SELECT a.q, a.r, coalesce(a.v, (SELECT arg_min(b.v, [greatest(abs(b.q - a.q), abs(b.r - a.r), abs(b.q - a.q + b.r - a.r)), b.q, b.r]) FROM g b WHERE b.v IS NOT NULL AND greatest(abs(b.q - a.q), abs(b.r - a.r), abs(b.q - a.q + b.r - a.r)) <= 2)) AS v FROM g a""",
)
def c27(t):
    h = t.pixels.select((F.col("lat_idx") % 60).alias("q"), (F.col("lon_idx") % 60).alias("r")).distinct()
    g = h.withColumn("v", F.when((F.col("q") * 7 + F.col("r") * 13) % 5 != 0, F.col("q") * 100 + F.col("r")))
    return G.ring_fill(g, "v", 2)


@query(
    "c28_grid_alignment_check",
    "pixels",
    "SELECT name, n AS cells, a AS lo_a, b AS hi_a, c AS lo_b, d AS hi_b, aligned FROM (SELECT 'npv' AS name, count(*) AS n, min(lat_idx) AS a, max(lat_idx) AS b, min(lon_idx) AS c, max(lon_idx) AS d, true AS aligned FROM pixels "
    "UNION ALL SELECT 'carbon', count(*), min(lat_idx), max(lat_idx), min(lon_idx), max(lon_idx), true FROM pixels UNION ALL SELECT 'prob', count(*), min(lat_idx), max(lat_idx), min(lon_idx), max(lon_idx), false FROM pixels WHERE pixel_id % 100 <> 0) x",
)
def c28(t):
    long = t.pixels.select("pixel_id", *KEYS, "npv", "carbon", "prob").unpivot(["pixel_id", *KEYS], ["npv", "carbon", "prob"], "name", "v")
    return J.alignment_check(long.where("name <> 'prob' or pixel_id % 100 <> 0"), "name", KEYS, "npv")


@query("f1_sort", "pixels", "SELECT state_key, pixel_id, round(npv, 4) AS npv FROM pixels")
def f1(t):
    return t.pixels.orderBy("state_key", F.desc("npv"), "pixel_id").select("state_key", "pixel_id", r4("npv").alias("npv"))


@query("f2_head", "pixels", "SELECT pixel_id, round(carbon, 4) AS carbon FROM pixels ORDER BY carbon DESC, pixel_id LIMIT 25")
def f2(t):
    return t.pixels.orderBy(F.desc("carbon"), "pixel_id").limit(25).select("pixel_id", r4("carbon").alias("carbon"))


@query("f2_sample", "pixels")
def f2b(t):
    return J.sample_rows(t.pixels, 500, 42, "pixel_id").select("pixel_id")


@query(
    "f3_union_missing",
    "sites pixels",
    "SELECT lat_idx, lon_idx, unique_id, NULL AS pixel_id FROM sites UNION ALL SELECT lat_idx, lon_idx, NULL, pixel_id FROM pixels",
)
def f3(t):
    return J.union_missing([t.sites.select(*KEYS, "unique_id"), t.pixels.select(*KEYS, "pixel_id")])


@query("f4_distinct", "npv", "SELECT DISTINCT policy_category, analysis_year FROM npv")
def f4(t):
    return t.npv.select("policy_category", "analysis_year").dropDuplicates()


@query("f5_intersect", "pixels sites", "SELECT lat_idx, lon_idx FROM pixels INTERSECT SELECT lat_idx, lon_idx FROM sites")
def f5(t):
    return t.pixels.select(*KEYS).intersect(t.sites.select(*KEYS))


@query("f6_remaining_pool", "pixels", "SELECT pixel_id FROM pixels WHERE NOT (prob > 0.5e0 AND npv > 0)")
def f6(t):
    return J.remaining_pool(t.pixels, t.pixels.where("prob > 0.5D and npv > 0"), ["pixel_id"]).select("pixel_id")
