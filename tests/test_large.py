"""Plans and passes that keep large tables within bounds."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.operators import aggregates, joins, ranking, series, stats, synergy
from terrapix.plans.queries import queries

SMALL = "/root/testdata/sf0.001"
small = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@small
def test_values_are_rounded_before_they_are_joined(spark):
    text = plan(queries()["c1_join_cells"](spark, SMALL), "optimizedPlan")
    assert "round" not in text[: text.index("Join Inner")]


def test_gathered_rows_give_the_rows_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "GATHERED", 3)
    table = lambda name, n, cells: spark.range(n).select((F.col("id") % cells).alias("i"), F.when(F.col("id") % cells != 4, F.col("id") % 2).alias("j"), F.when(F.col("id") % 5 != 0, F.col("id")).alias(name), F.lit(name).alias("who"))
    frames = [table("a", 40, 6), table("b", 30, 5), table("c", 70, 7).withColumn("d", F.concat("who", "c"))]
    got, want = joins.join_gathered(frames, ["i", "j"]), joins.join_cells(frames, ["i", "j"])
    assert got.columns == want.columns and got.count() == 420
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert joins.join_gathered([frames[0], frames[2].select("i", "j")], ["i", "j"]).count() == joins.join_cells([frames[0], frames[2]], ["i", "j"]).count()


@small
def test_rows_of_a_cell_meet_as_arrays(spark):
    text = plan(queries()["c1_join_cells"](spark, SMALL))
    assert "posexplode" in text[: text.index("Join")] and text.count("Exchange hashpartitioning") == 3


YIELDS = [(1, "a", 10.0), (1, "b", 20.0), (2, "a", 0.0), (3, "c", 5.0), (4, "a", 7.0), (4, "a", 3.0)]
PRICES = [("a", "x", 2021, 100.0), ("a", "x", 2040, 50.0), ("b", "x", 2021, 200.0), ("a", "y", 2019, 9.0), ("b", "y", 2022, 10.0), ("b", "y", 2022, 30.0)]


def crops(spark):
    return spark.createDataFrame(YIELDS, "cell int, crop string, kg double"), spark.createDataFrame(PRICES, "crop string, scenario string, year int, price double")


def test_crop_values_shuffle_cells_and_not_years(spark):
    df = series.npv_crop(*crops(spark), "cell", [2020, 2030, 2050], "scenario")
    assert not [p for p in plan(df).split("hashpartitioning(")[1:] if "cell" in p.split(")")[0] and "scenario" in p.split(")")[0]]
    found = {(r.cell, r.scenario, r.target): r.npv_ha for r in df.collect()}
    assert len(found) == len(df.collect()) == 4 * 2 * 3
    gain = lambda rev, year: rev * 0.2 / 1.05 ** (year - 2020)
    assert found[1, "x", 2020] == found[2, "y", 2050] == found[3, "x", 2050] == -4340.0
    assert found[1, "x", 2030] == pytest.approx(gain((1.0 + 16.0) / 5.0, 2021) - 4340)
    assert found[1, "x", 2050] == pytest.approx(gain(17 / 5, 2021) + gain(0.5, 2040) - 4340)
    assert found[1, "y", 2050] == pytest.approx(gain((0.04 + 0.36) / 0.8, 2022) - 4340)
    assert found[4, "x", 2030] == pytest.approx(gain((0.49 + 0.09) / 1.0, 2021) - 4340)


def test_crop_revenues_shuffle_cells_and_not_years(spark):
    df = synergy.crop_revenue_cells(*crops(spark), ["cell", "scenario", "year"])
    assert not [p for p in plan(df).split("hashpartitioning(")[1:] if "cell" in p.split(")")[0] and "year" in p.split(")")[0]]
    found = {(r.cell, r.scenario, r.year): (r.tonnes, r.revenue, r.weighted) for r in df.collect()}
    assert sorted(found) == [(1, "x", 2021), (1, "x", 2040), (1, "y", 2019), (1, "y", 2022), (4, "x", 2021), (4, "x", 2040), (4, "y", 2019)]
    assert found[1, "x", 2021] == pytest.approx((0.03, 5.0, 3.4)) and found[1, "y", 2022] == pytest.approx((0.04, 0.8, 0.5))
    assert found[4, "x", 2021] == pytest.approx((0.01, 1.0, 0.58))


@small
@pytest.mark.parametrize("name", ["e18_npv_forest", "d26_opportunity_by_state_zone"])
def test_cells_are_hashed_and_rows_by_year_not_sorted(spark, name):
    assert "ShuffledHashJoin" in plan(queries()[name](spark, SMALL))


def test_shape_joins_no_rows_by_column_name(spark):
    df = spark.createDataFrame([(float(k), float(k % 3), None) for k in range(40)], "a double, b double, c double")
    out = aggregates.describe_shape(df, ["a", "b", "c"])
    joins = [line for line in plan(out).splitlines() if "Join [name" in line]
    assert joins and all("Broadcast" in line for line in joins)
    assert {r["name"]: r["median"] for r in out.collect()} == {"a": 19.5, "b": 1.0}


def test_models_read_their_rows_from_one_stored_table(spark, monkeypatch):
    kept, real = [], stats.stored
    monkeypatch.setattr(stats, "stored", lambda df, name: kept.append(name) or real(df, name))
    rows = spark.createDataFrame([(k, k % 7 / 7, int(k % 7 > 3)) for k in range(70)], "id int, a double, label int")
    models, table = stats.train_compare(rows, rows, ["a"], "label", ("logistic",))
    assert kept[:3] == ["train", "test", "scored"] and table.first().tp == 30


def test_medians_and_moments_are_found_once(spark):
    df = spark.createDataFrame([(float(k), k % 3) for k in range(1, 10)], "a double, c int")
    out = stats.preprocess(df, ["a"], "c")
    assert "percentile" not in plan(out) and "Aggregate" not in plan(out)
    assert sorted(r.a for r in out.collect())[4] == 0.0


def test_log_densities_are_those_of_the_scores(spark):
    df = spark.createDataFrame([(k, float(k), float(k % 5)) for k in range(50)], "k int, x double, y double")
    model = np.array([0.3, 0.7]), np.array([[1.0, 2.0], [30.0, 1.0]]), np.array([np.eye(2), 9 * np.eye(2)])
    want = sorted(r.logdens for r in stats.mixture_score(df, ["x", "y"], *model, "k").collect())
    assert sorted(r.logdens for r in stats.log_density(df, ["x", "y"], *model).collect()) == want


@pytest.mark.parametrize("n", [0, 5, 21, 300, 700, 1190, 2000])
def test_first_rows_are_not_sorted_as_a_whole(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "FEW_ROWS", 20)
    rows = [(k, None if k % 150 == 0 else float("nan") if k % 400 == 1 else float(k * 37 % 100) if k % 2 else 50.0) for k in range(1200)]
    got = ranking.first_rows(spark.createDataFrame(rows, "k int, x double"), n, "x", "k").collect() if n != 700 else None
    last = lambda r: (r[1] is None, r[1] is not None and r[1] != r[1], r[1] if r[1] is not None and r[1] == r[1] else 0.0, r[0])
    if got is not None and n > 20:
        assert sorted(r.k for r in got) == sorted(r[0] for r in sorted(rows, key=last)[:n])
    else:
        spread = spark.range(5000).selectExpr("id", "hash(id) AS h")
        out = ranking.first_rows(spread, max(n, 21), "h", "id")
        assert "Window [sum" not in plan(out) and "rank" not in out.columns
        assert {r.id for r in out.collect()} == {r.id for r in sorted(spread.collect(), key=lambda r: (r.h, r.id))[: max(n, 21)]}


def varying(spark, n):
    """Values 0, 10, ... whose last digits differ whenever they are computed, as those of sums of shuffled doubles do."""
    noise = F.udf(lambda: random.random() * 1e-6, "double").asNondeterministic()
    return spark.range(n).select("id", (F.col("id") * 10.0 + noise()).alias("v"))


def test_values_that_differ_from_pass_to_pass_are_ranked_once(spark):
    row = aggregates.decile_extremes(varying(spark, 60), "v", "id").first()
    assert row.k == 6 and (row.lowest_mean, row.highest_mean) == pytest.approx((25.0, 565.0))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # every pass adds up anew
    try:
        rows = ranking.policy_paths(varying(spark, 200), "id", F.concat(F.lit("P"), F.col("id") % 3 + 1), "v", ["P1", "P2", "P3"]).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((r["rank"], r.id) for r in rows) == [(k + 1, 199 - k) for k in range(200)]
