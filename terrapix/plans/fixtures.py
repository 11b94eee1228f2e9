"""Projections of the given tables onto the library's input shapes, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings")
RCPS = "(VALUES (1, 'RCP2.6'), (2, 'RCP4.5'), (3, 'RCP6.0'), (4, 'RCP8.5')) AS rc(rk, rcp_category)"
YEARS = "(VALUES (2020), (2030), (2040), (2050)) AS ys(analysis_year)"


def _values(numbers: range, name: str, column: str) -> str:
    return "(VALUES " + ", ".join(f"({n})" for n in numbers) + f") AS {name}({column})"


VIEWS: dict[str, str] = {
    # one row per grid cell
    "pixels": """
        SELECT k AS pixel_id, lat_idx, lon_idx, 25e0 + 0.06e0 * lat_idx AS lat, -125e0 + 0.15e0 * lon_idx AS lon,
               1e4 * (40 + (k * 37) % 20) AS area_m2, CAST(o_custkey % 101 AS DOUBLE) / 1e2 AS prob,
               CAST((k * 61) % 9001 AS DOUBLE) / 1e1 - 3e2 AS carbon, o_totalprice - 2.5e5 AS npv,
               CAST((k * 13) % 1200 AS DOUBLE) / 1e2 + 8e0 AS rsds, CAST(2700 + (k * 17) % 350 AS DOUBLE) AS tas,
               CAST((k * 29) % 90 AS DOUBLE) / 1e1 AS wind,
               CAST((lat_idx - lat_idx % 80) / 80 AS INT) * 5 + CAST((lon_idx - lon_idx % 80) / 80 AS INT) AS state_key,
               CAST(1 + (k * 7) % 9 AS INT) AS landcover
        FROM (SELECT *, CAST(j % 400 AS BIGINT) AS lat_idx, CAST((j - j % 400) / 400 AS BIGINT) AS lon_idx
              FROM (SELECT o_orderkey AS k, o_custkey, o_totalprice, (o_orderkey * 7919) % 160000 AS j FROM orders) p) g""",
    "states": """
        SELECT n_nationkey AS state_key, n_name AS name,
               25e0 + 4.8e0 * ((n_nationkey - n_nationkey % 5) / 5) - 0.03e0 AS lat_lo,
               25e0 + 4.8e0 * ((n_nationkey - n_nationkey % 5) / 5) - 0.03e0 + 4.8e0 AS lat_hi,
               -125e0 + 12e0 * (n_nationkey % 5) - 0.075e0 AS lon_lo,
               -125e0 + 12e0 * (n_nationkey % 5) - 0.075e0 + 12e0 AS lon_hi
        FROM nation""",
    "sites": """
        SELECT c_custkey AS unique_id, CAST(j % 400 AS BIGINT) AS lat_idx, CAST((j - j % 400) / 400 AS BIGINT) AS lon_idx,
               25e0 + 0.06e0 * (j % 400) AS lat, -125e0 + 0.15e0 * ((j - j % 400) / 400) AS lon,
               CAST(2018 + 2 * (c_custkey % 2) AS INT) AS year, c_acctbal AS capacity_m,
               CAST(100 + c_custkey % 900 AS DOUBLE) AS p_area, c_mktsegment AS country
        FROM (SELECT *, (c_custkey * 104729) % 160000 AS j FROM customer) s""",
    # pixel x scenario x year values; the key is not unique
    "npv": """
        SELECT l_orderkey AS pixel_id, l_partkey AS model_id, l_suppkey AS scenario_id,
               concat('P', CAST(1 + l_suppkey % 3 AS STRING), '_', lower(l_linestatus)) AS policy_category,
               concat('C', CAST(1 + l_partkey % 8 AS STRING)) AS category,
               CAST(2020 + 10 * (l_linenumber % 4) AS INT) AS analysis_year,
               l_extendedprice - 4e4 AS npv_usd, l_extendedprice * l_discount AS cost_usd
        FROM lineitem""",
    "alts": f"""
        SELECT pixel_id, lat_idx, lon_idx, rcp_category, analysis_year,
               CAST((pixel_id * 17 + rk * 101 + analysis_year) % 5000 AS DOUBLE) - 2e3 AS npv_agri,
               CAST((pixel_id * 23 + rk * 211 + analysis_year) % 4000 AS DOUBLE) - 1.5e3 AS npv_forest,
               CAST(-1 * ((pixel_id * 29 + rk * 307) % 1000) AS DOUBLE) AS npv_natural,
               CAST((pixel_id * 31 + rk * 7) % 900 AS DOUBLE) AS cost_usd,
               CAST(1 + pixel_id % 3 AS DOUBLE) / CAST(1 + pixel_id % 3 + 1 + pixel_id % 5 + 1 + pixel_id % 7 AS DOUBLE) AS w_agri,
               CAST(1 + pixel_id % 5 AS DOUBLE) / CAST(1 + pixel_id % 3 + 1 + pixel_id % 5 + 1 + pixel_id % 7 AS DOUBLE) AS w_forest,
               CAST(1 + pixel_id % 7 AS DOUBLE) / CAST(1 + pixel_id % 3 + 1 + pixel_id % 5 + 1 + pixel_id % 7 AS DOUBLE) AS w_natural
        FROM pixels CROSS JOIN {RCPS} CROSS JOIN {YEARS}""",
    "lc_series": f"""
        SELECT pixel_id, lat_idx, lon_idx, CAST(lc_year AS INT) AS year,
               CAST(CASE WHEN lc_year < 1994 + pixel_id % 12 THEN 1 WHEN lc_year < 1994 + pixel_id % 12 + 3 + pixel_id % 9 THEN 5
                         WHEN pixel_id % 3 = 0 THEN 1 WHEN pixel_id % 3 = 1 THEN 7 ELSE 2 END AS INT) AS code
        FROM pixels CROSS JOIN {_values(range(1992, 2023), "ly", "lc_year")}""",
    "scen_long": f"""
        SELECT r_name AS model, n_name AS scenario, variable, analysis_year,
               CASE WHEN (n_nationkey * 7 + vk * 3 + analysis_year) % 11 = 0 AND vk = 3 THEN NULL
                    WHEN n_nationkey % 6 = 5 AND vk = 1 AND analysis_year = 2040 THEN NULL
                    ELSE CAST(5 + (n_nationkey * 13 + vk * 29 + analysis_year * 3) % 97 AS DOUBLE) END AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey
        CROSS JOIN (VALUES (1, 'price'), (2, 'capital'), (3, 'om')) AS vs(vk, variable) CROSS JOIN {YEARS}""",
    "scen_wide": """
        SELECT model, scenario, variable, max(CASE WHEN analysis_year = 2020 THEN value END) AS y2020,
               max(CASE WHEN analysis_year = 2030 THEN value END) AS y2030, max(CASE WHEN analysis_year = 2040 THEN value END) AS y2040,
               max(CASE WHEN analysis_year = 2050 THEN value END) AS y2050
        FROM scen_long GROUP BY model, scenario, variable""",
    "demand": f"""
        SELECT n_name AS state, scenario, sector, CAST(dy AS INT) AS year,
               CASE WHEN (n_nationkey + sk) % 4 = 0 THEN 'FUEL' ELSE 'ELECTRICITY' END AS final_energy,
               CAST(1000 + (n_nationkey * 97 + sk * 53 + (dy - 2000) * 17 + ck * 7) % 900 AS DOUBLE) AS mmbtu
        FROM nation CROSS JOIN (VALUES (1, 'LOW'), (2, 'MID'), (3, 'HIGH'), (4, 'FAST'), (5, 'REFERENCE')) AS dsn(sk, scenario)
        CROSS JOIN (VALUES (1, 'RESIDENTIAL'), (2, 'INDUSTRIAL'), (3, 'TRANSPORT')) AS dc(ck, sector)
        CROSS JOIN (VALUES (2015), (2017), (2020), (2030), (2040), (2050), (2060)) AS dys(dy)""",
    # wide crop yields per cell, the unit in the column's name
    "crops": """
        SELECT pixel_id, lat_idx, lon_idx, CAST((pixel_id * 3) % 400 AS DOUBLE) AS maize_rcp26_kg_dw_ha,
               CASE WHEN pixel_id % 9 = 0 THEN NULL ELSE CAST((pixel_id * 5) % 60 AS DOUBLE) END AS wheat_rcp26_10kg_dw_ha,
               CAST((pixel_id * 11) % 300 AS DOUBLE) AS soybean_rcp26_kg_dw_ha, CAST((pixel_id * 7) % 4 AS DOUBLE) AS jatropha_class,
               CAST((pixel_id * 5) % 6 AS DOUBLE) AS miscanthus_class, CAST((pixel_id * 3) % 5 AS DOUBLE) AS oilpalm_class
        FROM pixels""",
    "crop_price": f"""
        SELECT item, scenario, element, CAST(cy AS INT) AS year,
               CAST(CASE element WHEN 'value' THEN 100 + (ik * 37 + sk * 11 + cy) % 90 ELSE (ik * 13 + cy * 3) % 40 END AS DOUBLE) AS value
        FROM (VALUES (1, 'maize'), (2, 'wheat'), (3, 'soybean')) AS ci(ik, item)
        CROSS JOIN (VALUES (1, 'BAU'), (2, 'SSP1')) AS cs(sk, scenario) CROSS JOIN (VALUES ('value'), ('tonnes')) AS ce(element)
        CROSS JOIN {_values(range(2020, 2051, 5), "cys", "cy")}""",
    "intensity": """
        SELECT n_name AS scenario, n_nationkey AS sk, CAST(iy AS INT) AS year,
               CAST(400 - 10 * (n_nationkey % 7) - (iy - 2020) * (2 + n_nationkey % 5) AS DOUBLE) AS g_per_kwh
        FROM nation CROSS JOIN (VALUES (2020), (2030), (2040), (2050)) AS iys(iy)""",
}


def needs(name: str) -> list[str]:
    """Views that a view reads, the view itself last."""
    out: list[str] = []
    for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", VIEWS[name])):
        if word in VIEWS:
            out += [x for x in needs(word) if x not in out]
    return [*out, name]


def with_views(*names: str) -> str:
    """A WITH clause that defines views for DuckDB."""
    order = reduce(lambda a, n: a + [x for x in needs(n) if x not in a], names, [])
    body = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order).replace("AS STRING", "AS VARCHAR")
    return f"WITH {body}"


class Inputs:
    """The tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in {*VIEWS, *TABLES}:
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                used = {w for w in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", VIEWS[name]) if w in VIEWS or w in TABLES}
                sql = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in used else m[0], VIEWS[name])
                self._made[name] = self.spark.sql(sql, **{w: getattr(self, w) for w in used})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]
