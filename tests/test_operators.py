"""Small cases worked out by hand, properties, and brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.functions import distributions as D
from terrapix.operators import panel, ranking, scalar, series, spatial, stats, synergy
from terrapix.sources import tables


def test_distributions():
    assert D.t_two_sided(2.2281388519, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.t_quantile(0.975, 10) == pytest.approx(2.2281388519, abs=1e-6)
    assert D.f_upper(4.9646027, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)


def test_landcover_classes(spark):
    codes = [10, 40, 50, 160, 100, 121, 130, 153, 180, 190, 200, 220, 210, 999]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c int").select(scalar.reclass_landcover(F.col("c"))).collect()]
    assert got == [1, 1, 2, 2, 3, 4, 5, 5, 6, 7, 8, 8, 9, 999]


def test_turned_polygon(spark):
    """A square on its corner, with a hole, against the same test in plain Python; corners and sides are outside."""
    ring = [(0.0, -3.0), (3.0, 0.0), (0.0, 3.0), (-3.0, 0.0)]
    hole = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    rings = [[{"x": x, "y": y} for x, y in r] for r in (ring, hole)]
    poly = spark.createDataFrame([("sq", rings)], "name string, rings array<array<struct<x:double,y:double>>>")
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-4, 4), rnd.uniform(-4, 4)) for i in range(500)] + [(900, 0.0, 3.0), (901, 1.5, 1.5), (902, 0.0, 0.0), (903, 1.0, 0.5), (904, None, 1.0)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = {r.id for r in spatial.clip_points(df, poly, "id").collect()}
    want = {i for i, x, y in pts if x is not None and abs(x) + abs(y) < 3 and not (abs(x) <= 1 and abs(y) <= 1)}
    assert got == want


def test_nearest_against_brute_force(spark):
    rnd = random.Random(2)
    src = [(i, rnd.gauss(0, 1) ** 3, rnd.gauss(0, 1) ** 3) for i in range(400)]
    tgt = [(i, rnd.uniform(-30, 30), rnd.uniform(-30, 30)) for i in range(150)]
    got = spatial.nearest(spark.createDataFrame(tgt, "t int, lon double, lat double"), spark.createDataFrame(src, "s int, lon double, lat double"), "t", "s", [], 5).collect()
    have = {}
    for r in got:
        have.setdefault(r.t, []).append((r["rank"], r.s))
    for t, x, y in tgt:
        want = sorted(((x - a) ** 2 + (y - b) ** 2, s) for s, a, b in src)[:5]
        assert [s for _, s in sorted(have[t])] == [s for _, s in want]


def test_nearest_without_sources(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "t int, lon double, lat double")
    assert spatial.nearest(df, df.where("false").withColumnRenamed("t", "s"), "t", "s", []).count() == 0


def test_ranked_prefix_with_ties_and_nulls(spark):
    rows = [(i, float(i % 7) if i % 11 else None, i % 3) for i in range(500)]
    got = {r.id: (r["rank"], r.cum_v) for r in ranking.ranked_prefix(spark.createDataFrame(rows, "id int, x double, v int"), "x", "id", ["v"], levels=3).collect()}
    total = 0
    for k, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1):
        total += v
        assert got[i] == (k, total)


def test_ranked_prefix_of_one_value(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id") / 1000).alias("x"), F.lit(1).alias("v"))
    order = sorted(((-(1.0 if i % 3 else i / 1000)), i) for i in range(2000))
    got = {r.id: (r["rank"], r.cum_v) for r in ranking.ranked_prefix(df, "x", "id", ["v"], levels=4).collect()}
    assert got == {i: (k, k) for k, (_, i) in enumerate(order, 1)}


def test_abandonment_matches_plain_regex(spark):
    rnd = random.Random(3)
    cells = ["11" + "".join(rnd.choice("111000000007") for _ in range(29)) for _ in range(300)]
    rows = [(i, 1992 + y, {"1": 1, "0": 5, "7": 7}[c]) for i, s in enumerate(cells) for y, c in enumerate(s)]
    got = {r.cell: (r.start_year, r.duration, r.recultivated, r.built, r.current) for r in series.detect_abandonment(spark.createDataFrame(rows, "cell int, year int, code int"), ["cell"]).collect()}
    want = {}
    for i, s in enumerate(cells):
        if m := re.match(r"^(.*11)(0{5,})(.*)$", s):
            want[i] = (1992 + len(m[1]), len(m[2]), int("11" in m[3]), int("7" in m[3]), int(m[3] == ""))
    assert got == want


def test_later_class_tie_goes_to_the_first_to_reach_it(spark):
    rows = [(1, 2000 + k, c) for k, c in enumerate([5, 2, 2, 5])] + [(2, 2000 + k, c) for k, c in enumerate([5, 1, 1, 5])]
    events = spark.createDataFrame([(1, 2000), (2, 2000)], "cell int, start_year int")
    got = {r.cell: r.later_class for r in series.post_abandonment_class(spark.createDataFrame(rows, "cell int, year int, code int"), events, ["cell"]).collect()}
    assert got == {1: 2, 2: 1}


def test_interpolation_ends(spark):
    knots = spark.createDataFrame([("a", 2020, 1.0), ("a", 2030, 3.0), ("b", 2020, 7.0), ("c", 2020, None)], "k string, x int, y double")
    held = {(r.k, r.x): r.y for r in series.interp_series(knots, ["k"], "x", "y", [2010, 2025, 2040]).collect()}
    assert held == {("a", 2010): 1.0, ("a", 2025): 2.0, ("a", 2040): 3.0, ("b", 2010): 7.0, ("b", 2025): 7.0, ("b", 2040): 7.0}
    more = {r.x: r.y for r in series.interp_series(knots.where("k = 'a'"), ["k"], "x", "y", [2010, 2040], "extend").collect()}
    assert more == {2010: -1.0, 2040: 5.0}


def test_panel_balance_is_solved(spark):
    df = spark.createDataFrame([(1, 600.0, 295.0, 2.0, 12.0), (2, 0.0, 280.0, 5.0, 8.0), (3, None, 280.0, 5.0, 8.0)], "k int, s double, a double, w double, v double")
    got = {r.k: r for r in panel.panel_efficiency(df, "k", "s", "a", "w", "v").collect()}
    for k, s, a, w, v in ((1, 600.0, 295.0, 2.0, 12.0), (2, 0.0, 280.0, 5.0, 8.0)):
        flux, _ = panel.balance(np.array([got[k].panel_k]), *(np.array([x]) for x in (s, a, w, v)))
        assert abs(flux[0]) < 1e-6
    assert got[3].efficiency is None


def test_front_and_weights(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.random(), rnd.random(), rnd.random()) for i in range(400)] + [(900, 0.5, 0.5, None)]
    front = {r.id for r in synergy.pareto_front(spark.createDataFrame(rows, "id int, a double, b double, c double"), ["a", "b", "c"]).collect()}
    whole = rows[:-1]
    beats = lambda p, q: all(x >= y for x, y in zip(p, q, strict=True)) and p != q
    assert front == {r[0] for r in whole if not any(beats(o[1:], r[1:]) for o in whole)}
    assert all(abs(r.l1 + r.l2 + r.l3 - 1) < 1e-12 for r in synergy.lambda_grid(spark, 10).collect())
    assert all(abs(r.l1 + r.l2 + r.l3 - 1) < 1e-12 for r in synergy.dirichlet(spark, 50).collect())


def test_best_weights_beat_a_fine_grid(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), rnd.random() ** 2, rnd.random() ** 0.5) for _ in range(200)]
    best = synergy.ccd_optimize(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).first()
    u = np.array(rows)
    c = (u.prod(1) / u.mean(1) ** 3) ** (1 / 3)
    grid = [(i / 40, j / 40) for i in range(41) for j in range(41 - i)]
    top = max(np.sqrt(c * (u @ np.array([a, b, 1 - a - b]))).mean() for a, b in grid)
    assert best.ccd >= top - 1e-4


def test_mixture_score_sums_to_one(spark):
    w, m = np.array([0.4, 0.6]), np.array([[0.0, 0.0], [3.0, 1.0]])
    c = np.array([np.eye(2), [[2.0, 0.3], [0.3, 1.0]]])
    df = spark.createDataFrame([(1, 0.1, 0.2), (2, 3.0, 1.0)], "k int, x double, y double")
    for r in stats.mixture_score(df, ["x", "y"], w, m, c, "k").collect():
        x = np.array([[0.1, 0.2], [3.0, 1.0]][r.k - 1])
        dens = sum(w[i] * math.exp(-0.5 * (x - m[i]) @ np.linalg.inv(c[i]) @ (x - m[i])) / (2 * math.pi * math.sqrt(np.linalg.det(c[i]))) for i in range(2))
        assert r.logdens == pytest.approx(math.log(dens)) and sum(r.posterior) == pytest.approx(1)


def test_selection_and_rest_are_the_pool(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.rand(1)).alias("x"))
    pos, pool = rows.where("k % 10 = 0"), rows.where("k % 10 <> 0")
    got = stats.negatives_by_selection(pos, pool, "x", "k", 0.2)
    again = stats.negatives_by_selection(pos, pool, "x", "k", 0.2)
    keys = {r.k for r in got.collect()}
    assert keys == {r.k for r in again.collect()} and 0 < len(keys) <= 40
    assert pool.join(got.select("k"), "k", "left_anti").count() + len(keys) == pool.count()


def test_least_squares(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(300, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.5 + rnd.normal(size=300) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = {r.term: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    want = np.linalg.lstsq(np.column_stack([x, np.ones(300)]), y, rcond=None)[0]
    for name, v in zip(("a", "b", "intercept"), want, strict=True):
        assert got[name].coefficient == pytest.approx(v, abs=1e-8)
    assert got["a"].p < 1e-6 and got["a"].vif == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2))


def test_readers(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("a", "1.5", "2.5", "2020", "3", "4", "X"), ("b", "1", "2", "2018", "3", "4", "X")], "unique_id string, LAT string, longitude string, time string, p_area string, capacity_m string, country string").write.option("header", True).csv(path)
    got = tables.read_points(spark, path, [2020]).collect()
    assert [(r.unique_id, r.lat, r.lon, r.year) for r in got] == [("a", 1.5, 2.5, 2020)]
    with pytest.raises(ValueError, match="country"):
        bad = str(tmp_path / "bad")
        spark.createDataFrame([("a", 1.0, 2.0, "2020", 1.0, 1.0)], "unique_id string, lat double, lon double, time string, p_area double, capacity_m double").write.option("header", True).csv(bad)
        tables.read_points(spark, bad)


def test_written_tiles_are_not_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    df = tables.tile(spark.createDataFrame([(0, 0, 1.0), (600, 0, 2.0)], "lat_idx int, lon_idx int, v double"))
    tables.write_tiles(df, path)
    tables.write_tiles(df.withColumn("v", F.lit(9.0)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0]
