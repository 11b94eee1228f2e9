"""States of batches, writes that are run again, samples of hot groups, fronts, weights and exponents."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.operators import aggregates, ranking, stats, synergy
from terrapix.sources import tables


def test_states_of_batches_in_any_order_and_repeated(spark, tmp_path):
    rows = [(i % 3, None if i % 7 == 0 else float(i % 11 - 5), float(i)) for i in range(200)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, v double, c double, i int")
    path = str(tmp_path / "states")
    for part in (2, 0, 1, 0, 2):
        aggregates.write_state(df.where(F.col("i") % 3 == part), path, f"b{part}", ["k"], "v", "c")
    got = {r.k: r for r in aggregates.read_summary(spark, path, ["k"], True, True).collect()}
    want = {r.k: r for r in aggregates.summary(df, ["k"], "v", "c", True).collect()}
    for k, w in want.items():
        assert (got[k].n, got[k].lowest, got[k].highest) == (w.n, w.lowest, w.highest)
        for c in ("total", "mean", "mean_cost", "viable_pct"):
            assert got[k][c] == pytest.approx(w[c])


def test_tiles_of_a_job_that_failed_half_way(spark, tmp_path):
    path = str(tmp_path / "tiles")
    df = spark.range(400).select(F.col("id").alias("lat_idx"), (F.col("id") % 40).alias("lon_idx"), F.rand(1).alias("v"))
    tiled = tables.tile(df, 20)
    tables.write_tiles(tiled.where("tile_id < 4000"), path)
    broken = tiled.withColumn("v", F.when(F.col("lat_idx") == 399, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        tables.write_tiles(broken, path)
    left = tiled.where("tile_id = 9000").limit(3)  # a folder that a failed job has left
    left.write.mode("append").partitionBy("tile_id").parquet(path)
    tables.write_tiles(tiled, path)
    tables.write_tiles(tiled, path)
    got = spark.read.parquet(path).groupBy("lat_idx", "lon_idx").count().collect()
    assert len(got) == 400 and all(r["count"] == 1 for r in got)
    assert tables.finished_tiles(spark, path).count() == tiled.select("tile_id").distinct().count()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_facts_of_a_batch_run_again(spark, tmp_path, fmt):
    df = spark.range(90).select("id", (2020 + F.col("id") % 3).cast("int").alias("analysis_year"))
    path = str(tmp_path / "fact")
    for part in (0, 1, 0):
        tables.write_fact(df.where(F.col("id") % 2 == part), path, fmt=fmt, batch=f"b{part}")
    read = spark.read.option("header", True).format(fmt).load(path)
    assert sorted(int(r.id) for r in read.select("id").collect()) == list(range(90))
    tables.write_fact(df.where("analysis_year = 2021 and id < 10"), path + "2", fmt=fmt)
    tables.write_fact(df.where("analysis_year = 2022"), path + "2", fmt=fmt)
    assert spark.read.option("header", True).format(fmt).load(path + "2").count() == 33


@pytest.mark.parametrize("n", [3, 40])
def test_first_rows_of_a_group_with_half_of_all(spark, monkeypatch, n):
    rows = [(0 if i % 2 else i % 9, (i * 7919) % 1000, i // 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, x int, k int")
    want = sorted(r for g in {r[0] for r in rows} for r in sorted((x for x in rows if x[0] == g), key=lambda r: (r[1], r[2]))[:n])
    for few in (10_000, 0):
        monkeypatch.setattr(ranking, "FEW_ROWS", few)
        assert sorted(map(tuple, ranking.first_rows(df, n, "x", "k", ["g"]).collect())) == want
        whole = sorted(map(tuple, ranking.first_rows(df, n, "x", "k").collect()))
        assert whole == sorted(sorted(rows, key=lambda r: (r[1], r[2]))[:n])


def brute_front(x):
    return {i for i in range(len(x)) if not ((x >= x[i]).all(1) & (x > x[i]).any(1)).any()}


@pytest.mark.parametrize("columns", [1, 2, 3, 4])
def test_fronts_by_merging_ranges(spark, monkeypatch, columns):
    monkeypatch.setattr(synergy, "FRONT_RANGE", 20)
    monkeypatch.setattr(synergy, "RANGE", 20)
    monkeypatch.setattr(synergy, "CHAMPIONS", 3)
    rng = np.random.default_rng(columns)
    x = np.round(rng.uniform(-1, 1, (250, columns)), 1 if columns < 3 else 2)
    x = np.concatenate([x, x[:20]])
    if columns > 1:
        t = np.linspace(0, np.pi / 2, 120)[:, None]
        x = np.concatenate([x, np.concatenate([np.cos(t), np.sin(t), *[0 * t] * (columns - 2)], 1)])
    names = [f"c{i}" for i in range(columns)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k int, " + ", ".join(f"{c} double" for c in names))
    assert {r.k for r in synergy.pareto_front(df, names).collect()} == brute_front(x)


def test_a_sweep_of_200_000_points_that_are_all_on_the_front():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(200_000, 3)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert synergy.swept(x).sum() > 199_990  # only rounding can put a point inside the sphere
    y = np.round(rng.uniform(size=(500, 3)), 1)
    y = np.unique(y, axis=0)
    assert set(np.flatnonzero(synergy.swept(y))) == brute_front(y)


def test_best_weights_by_newton_steps(spark):
    rng = np.random.default_rng(3)
    u = rng.uniform(size=(300, 3)) ** [1, 3, 0.5]
    c = (u.prod(1) / u.mean(1) ** 3) ** (1 / 3)
    for columns, scale in ((["a", "b", "c"], [1, 1, 1]), (["a", "b", "c"], [1, 0.2, 0.9])):
        v = u * scale
        best = synergy.ccd_optimize(spark.createDataFrame(v.tolist(), "a double, b double, c double"), columns).first()
        c = (v.prod(1) / v.mean(1) ** 3) ** (1 / 3)
        value = lambda w, v=v, c=c: np.sqrt(c * (v @ w)).mean()
        w = np.array([best.l1, best.l2, best.l3])
        assert best.gap < 1e-8 and best.ccd == pytest.approx(value(w), abs=1e-12) and (w >= 0).all() and w.sum() == pytest.approx(1)
        near = [w + 1e-3 * np.array(d) for d in ((1, -1, 0), (-1, 1, 0), (1, 0, -1), (-1, 0, 1), (0, 1, -1), (0, -1, 1))]
        assert all(value(p) <= best.ccd + 1e-12 for p in near if (p >= 0).all())
    assert synergy.ccd_optimize(spark.createDataFrame([], "a double, b double, c double"), ["a", "b", "c"]).count() == 0


def likelihood(x, lam, kind):
    if kind == "box_cox":
        y = np.log(x) if lam == 0 else (x**lam - 1) / lam
        return -len(x) / 2 * math.log(y.var()) + (lam - 1) * np.log(x).sum()
    part = lambda v, g: np.log(v) if abs(g) < 1e-12 else (v**g - 1) / g
    y = np.where(x >= 0, part(np.abs(x) + 1, lam), -part(np.abs(x) + 1, 2 - lam))
    return -len(x) / 2 * math.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


@pytest.mark.parametrize("kind,power", [("box_cox", 4.0), ("box_cox", 1.0), ("yeo_johnson", 1.0), ("box_cox", 0.2)])
def test_best_exponent_against_a_plain_search(spark, kind, power):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(3, 0.5, 500)) ** power if kind == "box_cox" else rng.normal(size=500) ** 3
    found = stats.best_lambda(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", kind)
    low, high = found.lam - 1, found.lam + 1
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if likelihood(x, a, kind) < likelihood(x, b, kind) else (low, b)
    assert abs(found.lam - (low + high) / 2) < 1e-4 and found.jobs <= 8


def test_recommended_transform_is_applied(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8, 16, 33)], "x double")
    out, power = stats.transform_recommended(df, "x")
    assert power.kind == "box_cox" and abs(power.lam) < 0.2
    got = [r.transformed for r in out.orderBy("x").collect()]
    assert got == pytest.approx([(v**power.lam - 1) / power.lam for v in (1, 2, 4, 8, 16, 33)])
    signed, other = stats.transform_recommended(df.union(spark.createDataFrame([(-3.0,), (None,)], "x double")), "x")
    assert other.kind == "yeo_johnson" and signed.where("transformed is null").count() == 1
    assert stats.transform_recommended(df.where("false"), "x")[1] is None
