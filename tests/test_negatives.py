"""Chosen and generated negatives: numbers, levels, cuts and nearest positives by brute force."""

import numpy as np
import pytest

from terrapix.operators import stats


@pytest.fixture(scope="module")
def positives(spark):
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, v)) for k, v in enumerate(rng.normal(size=(300, 3)))]
    return spark.createDataFrame(rows, "k long, x double, y double, z double")


def test_as_many_rows_as_asked_for_near_positives(spark, positives):
    w, m, c = np.array([1.0]), np.zeros((1, 3)), np.eye(3)[None]
    cut = -1.5 * np.log(2 * np.pi) - 1.5 - np.sqrt(1.5)  # mean less deviation of the log density
    plain = stats.negatives_by_generation(positives, "k", w, m, c, list("xyz"), 200, cut, jitter=0.0).collect()
    got = stats.negatives_by_generation(positives, "k", w, m, c, list("xyz"), 200, cut).collect()
    own = {r.k: np.array([r.x, r.y, r.z]) for r in positives.collect()}
    assert len({r.id for r in got}) == 200 == len(got)
    assert {(r.id, r.nearest) for r in got} == {(r.id, r.nearest) for r in plain}
    assert all((own[r.nearest] == [r.x, r.y, r.z]).all() for r in plain)
    noise = np.array([np.array([r.x, r.y, r.z]) - own[r.nearest] for r in got]) / np.array(list(own.values())).std(0)
    assert np.abs(noise.mean(0)).max() < 0.05 and np.abs(noise.std(0) - 0.15).max() < 0.03


def test_mixed_negatives_have_both_shares(spark):
    a = spark.range(100).selectExpr("id", "'chosen' AS kind")
    b = spark.range(1000, 1100).selectExpr("id", "'made' AS kind")
    rows = stats.negatives_hybrid(a, b, 50).collect()
    assert sorted(r.kind for r in rows) == ["chosen"] * 35 + ["made"] * 15 and len({r.id for r in rows}) == 50


def test_negatives_of_each_level_by_hand(spark):
    pos = [(k, k / 50) for k in range(50)]
    pool = [(1000 + k, (k % 97) / 97) for k in range(600)]
    df = lambda rows: spark.createDataFrame(rows, "k long, v double")
    for levels, strategy in ((3, "mixed"), (2, "hard")):
        got = stats.negatives_by_selection(df(pos), df(pool), "v", "k", strategy=strategy, levels=levels).collect()
        share = {k: np.mean([p[1] <= v for p in pos]) for k, v in pool}
        bins, shares = stats.PIT_BINS[levels], stats.SHARES[levels][strategy]
        for i in range(levels):
            fit = {k for k, s in share.items() if bins[i] <= s < bins[i + 1]}
            own = [r.k for r in got if r.level == i]
            assert set(own) <= fit and len(own) == len(set(own)) == min(len(fit), round(50 * shares[i]))
        assert all(r.pit == pytest.approx(share[r.k]) for r in got)
    both = stats.labelled_union(df(pos), df([(r.k, r.v) for r in got]), ["k", "v"]).collect()
    assert sum(r.label for r in both) == 50 and len(both) == 50 + len(got)


def test_samples_of_groups_and_rows(spark):
    df = spark.range(500).selectExpr("id", "id % 7 AS g", "if(id < 3, 1, 0) AS h")
    got = stats.sample_by_group(df, ["g", "h"], 20, "id").collect()
    size = lambda rows: {k: sum((r.g, r.h) == k for r in rows) for k in {(r.g, r.h) for r in rows}}
    assert size(got) == {k: min(20, n) for k, n in size(df.collect()).items()}
    assert {r.id for r in got} == {r.id for r in stats.sample_by_group(df.repartition(5), ["g", "h"], 20, "id").collect()}
