"""Quantiles, ranks, fronts, mixtures and models against plain numpy and the standard library."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.functions import distributions as D
from terrapix.operators import aggregates, ranking, spatial, stats, synergy
from terrapix.operators.quantiles import bounds_of, count_below, quantiles

QS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


def test_quantiles_with_ties_nulls_and_groups(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 4, 700)]).tolist()
    rows = [(k % 3, v, float(k % 11)) for k, v in enumerate(x)] + [(0, None, None), (1, float("nan"), 1.0), (7, None, 2.0), (None, 4.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double, w double").repartition(6)
    one = quantiles(df, {"v": F.col("v"), "w": F.col("w"), "none": F.lit(None).cast("double")}, QS).first()
    whole = [v for _, v, _ in rows if v is not None and not math.isnan(v)]
    assert one.v == pytest.approx(np.quantile(whole, QS).tolist()) and one.none is None
    assert one.w == pytest.approx(np.quantile([w for *_, w in rows if w is not None], QS).tolist())
    got = {r.g: r.v for r in quantiles(df, {"v": F.col("v")}, QS, ["g"]).collect()}
    assert set(got) == {0, 1, 2, None}
    for g, v in got.items():
        assert v == pytest.approx(np.quantile([b for a, b, _ in rows if a == g and b is not None and not math.isnan(b)], QS).tolist())
    assert quantiles(df.where("false"), {"v": F.col("v")}, QS).first().v is None


def test_bounds_are_counted_by_binary_search(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(float(rnd.randint(0, 20)),) for _ in range(300)] + [(None,)], "x double")
    both = df.crossJoin(df.agg(bounds_of(F.col("x"), 3).alias("q")))
    for r in count_below(count_below(both, "x", "q", 3, "lo"), "x", "q", 3, "hi", True).collect():
        assert r.lo == (0 if r.x is None else sum(b < r.x for b in r.q)) and r.hi == (0 if r.x is None else sum(b <= r.x for b in r.q))


def test_ranks_with_text_keys_groups_and_clashing_names(spark):
    rnd = random.Random(3)
    rows = [(f"key {rnd.randint(0, 10**6)}-{k}", float(rnd.choice([1, 1, 1, 1, 2, 3])), k % 2, 9, 9) for k in range(800)]
    df = spark.createDataFrame(rows, "k string, v double, g int, n int, rank int").repartition(5)
    got = ranking.ranked_prefix(df, "v", "k", ["v"], by=["g"])
    assert sorted(got.columns) == ["cum_v", "g", "k", "n", "rank", "v"]
    for g in (0, 1):
        want = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))
        have = sorted((r["rank"], r.k, r.n, r.cum_v) for r in got.where(F.col("g") == g).collect())
        assert have == [(i + 1, r[0], len(want), sum(x[1] for x in want[: i + 1])) for i, r in enumerate(want)]


def test_extreme_tenths(spark):
    df = spark.createDataFrame([(k, float((k * 37) % 101)) for k in range(95)], "k int, v double")
    v = sorted((k * 37) % 101 for k in range(95))
    r = aggregates.decile_extremes(df, "v", "k").first()
    assert (r.lowest_mean, r.highest_mean, r.k) == (pytest.approx(np.mean(v[:9])), pytest.approx(np.mean(v[-9:])), 9)


@pytest.mark.parametrize("shape", ["front", "cloud", "ties"])
def test_front_by_brute_force(spark, monkeypatch, shape):
    rng = np.random.default_rng(4)
    x = rng.random((400, 3)) if shape == "cloud" else rng.integers(0, 5, (400, 3)).astype(float)
    if shape == "front":
        t = rng.random(400)
        x = np.stack([t, 1 - t, np.zeros(400)], 1)
    monkeypatch.setattr(synergy, "RANGE", 40)
    monkeypatch.setattr(synergy, "CHAMPIONS", 8)
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)] + [(900, None, 1.0, 1.0)], "k int, a double, b double, c double")
    y = x * [1, 1, -1]
    want = {k for k in range(400) if not ((y >= y[k]).all(1) & (y > y[k]).any(1)).any()}
    assert {r.k for r in synergy.pareto_front(df, ["a", "b", "c"], [True, True, False]).collect()} == want


def test_nearest_in_a_dense_town_and_in_three_dimensions(spark, monkeypatch):
    for name, value in (("LEAF", 8), ("SAMPLE", 128), ("TARGETS", 7), ("PLACE_PARTS", 3)):
        monkeypatch.setattr(spatial, name, value)
    rng = np.random.default_rng(5)
    src = np.concatenate([rng.normal(size=(300, 3)) * 0.01, rng.normal(size=(60, 3)) * 20])
    tgt = np.concatenate([rng.normal(size=(40, 3)) * 0.01, rng.normal(size=(40, 3)) * 20])
    frame = lambda x, k: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{k} int, x double, y double, z double")
    for axes in (("x", "y"), ("x", "y", "z")):
        d = len(axes)
        d2 = ((tgt[:, None, :d] - src[None, :, :d]) ** 2).sum(2)
        got = {r.t: r.s for r in spatial.nearest(frame(tgt, "t"), frame(src, "s"), "t", "s", [], axes=axes).collect()}
        assert got == {i: int(d2[i].argmin()) for i in range(len(tgt))}


def plain_em(x, model, rounds):
    for _ in range(rounds):
        logs = model.parts(x)
        share = np.exp(logs - logs.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        n = share.sum(0)
        means = share.T @ x / n[:, None]
        covs = np.array([(share[:, k, None] * (x - means[k])).T @ (x - means[k]) / n[k] for k in range(len(n))]) + stats.RIDGE * np.eye(x.shape[1])
        model = stats.Mixture(n / n.sum(), means, covs, False)
    return model


def test_mixture_is_that_of_plain_steps_and_finds_what_was_planted(spark):
    rng = np.random.default_rng(6)
    centres = np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0]])
    x = np.concatenate([rng.normal(size=(150, 2)) + c for c in centres])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "k int, a double, b double").repartition(4)
    best, table = stats.fit_mixture(df, ["a", "b"], [1, 2, 3, 4], "k", restarts=3)
    assert len(best.weights) == 3 and len(table) == 12
    assert np.abs(np.sort(best.means.sum(1)) - [0, 6, 7]).max() < 0.5
    dense = lambda m: np.log(np.exp(m.parts(x)).sum(1)).sum()
    assert dense(best) == pytest.approx(next(t[2] for t in table if t[3] == min(u[3] for u in table)), rel=1e-6)
    assert dense(best) >= dense(plain_em(x, best, 30)) - 2
    diagonal, _ = stats.fit_mixture(df, ["a", "b"], [3], "k", diagonal=True)
    assert np.allclose(diagonal.covs[:, 0, 1], 0)
    chosen, held = stats.fit_mixture(df, ["a", "b"], [1, 3], "k", criterion="heldout")
    assert len(chosen.weights) == 3 and max(held, key=lambda t: t[4])[0] == 3


def test_log_densities_as_products_of_values(spark):
    rng = np.random.default_rng(8)
    covs = np.array([np.cov(rng.normal(size=(3, 9))) for _ in range(4)])
    model = stats.Mixture(np.array([0.1, 0.2, 0.3, 0.4]), rng.normal(size=(4, 3)), covs, False)
    x = rng.normal(size=(50, 3)) * 3
    forms, stiff = model.forms()
    both = np.concatenate([np.ones((50, 1)), x, (x[:, :, None] * x[:, None, :]).reshape(50, -1)], 1)
    assert np.allclose(both @ forms.T, model.parts(x), rtol=1e-10)
    assert stiff == pytest.approx(1 / np.linalg.eigvalsh(covs).min())
    far = np.concatenate([np.repeat([1e3, 3e3], 40), 1e3 + 1e3 * rng.random(40)])  # two values held by many rows: precisions of 1e6
    best, table = stats.fit_mixture(spark.createDataFrame([(k, float(v)) for k, v in enumerate(far)], "k int, a double"), ["a"], [3], "k", restarts=1)
    assert table[0][2] == pytest.approx(np.log(np.exp(best.parts(far[:, None])).sum(1)).sum(), rel=1e-3)


def test_distribution_functions(spark):
    p = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0]], "p double")
    got = [r[0] for r in df.select(D.probit(F.col("p"))).collect()]
    assert got[:-2] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-7, abs=1e-8) and got[-2:] == [None, None]
    assert [r[0] for r in spark.createDataFrame([(10,), (0,), (None,)], "n int").select(D.t_critical(F.col("n"))).collect()] == [pytest.approx(2.2281388519), None, None]
    grid = np.linspace(-60, 60, 240_001)
    for t, n in ((2.5, 4), (-0.7, 30)):
        dens = math.gamma((n + 1) / 2) / math.gamma(n / 2) / math.sqrt(n * math.pi) * (1 + grid**2 / n) ** (-(n + 1) / 2)
        tail = dens[np.abs(grid) >= abs(t)].sum() * (grid[1] - grid[0])
        assert spark.range(1).select(D.t_p_value(F.lit(t), F.lit(n))).first()[0] == pytest.approx(tail, abs=1e-3)


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ [1.5, -2.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    rows = {r.term: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([x, np.ones(200)])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    s2 = rss[0] / 197
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)
    for name, b, e in zip(("a", "b", "intercept"), beta, errors, strict=True):
        assert rows[name].coefficient == pytest.approx(b) and rows[name].error == pytest.approx(e) and rows[name].t == pytest.approx(b / e)
    r2 = 1 - rss[0] / ((y - y.mean()) ** 2).sum()
    assert rows["a"].r2 == pytest.approx(r2) and rows["a"].condition == pytest.approx(np.linalg.cond(design))
    ll = -100 * (np.log(2 * np.pi * rss[0] / 200) + 1)
    assert rows["a"].aic == pytest.approx(6 - 2 * ll) and rows["a"].bic == pytest.approx(3 * np.log(200) - 2 * ll)
    assert aggregates.condition_number(df, ["a", "b"]) == pytest.approx(np.linalg.cond(np.cov(x.T)))
    one = aggregates.quality_summary(df.withColumn("flat", F.lit(1.0)), ["a", "b", "flat"]).first()
    assert (one.n_rows, one.nans, one.no_variance, one.low_variance) == (200, 0, 1, 1) and one.condition > 1e9


def test_models_are_compared_on_rows_they_have_not_seen(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(k, *map(float, v), int(v[0] + v[1] > 0)) for k, v in enumerate(x)], "k int, a double, b double, label int")
    parts = stats.stratified_split(df, "label", "k")
    ids = [{r.k for r in parts.where(f"part = {p}").collect()} for p in range(3)]
    assert sum(map(len, ids)) == 400 == len(set().union(*ids)) and abs(len(ids[0]) - 240) <= 1
    models, table = stats.train_compare(parts.where("part = 0"), parts.where("part = 2"), ["a", "b"], "label")
    rows = table.collect()
    assert {r.model for r in rows} == set(models) == {"forest", "boosted", "logistic", "mlp"} and rows[0].f1 == max(r.f1 for r in rows) >= 0.95
    scored = {r.k: r.p for r in stats.score_model(models["logistic"], parts.where("part = 2"), ["a", "b"]).collect()}
    assert np.mean([(scored[k] >= 0.5) == (x[k].sum() > 0) for k in ids[2]]) >= 0.95
    curve = stats.learning_curve(df, ["a", "b"], "label", "k").collect()
    assert sorted(r["size"] for r in curve) == [0.2, 0.6, 1.0]
    assert all(r.valid > 0.9 and r.gap == pytest.approx(r.train - r.valid) for r in curve)


def test_pattern_scores_of_cells_against_plain_means(spark):
    rng = np.random.default_rng(11)
    weights, means = np.array([0.2, 0.5, 0.3]), rng.normal(size=(3, 4))
    covs = np.array([np.diag(rng.uniform(0.5, 2, 4)) for _ in range(3)])
    groups = {"value": [0, 2], "carbon": [1], "weather": [3]}
    table = stats.pattern_score(weights, means, covs, groups)
    plain = {(k, g): sum(abs(means[k, i]) * math.sqrt(covs[k, i, i]) for i in idx) * weights[k] for k in range(3) for g, idx in groups.items()}
    assert {(k, g): s for k, g, s in table} == pytest.approx(plain)
    p = rng.dirichlet(np.ones(3), 60)
    df = spark.createDataFrame([(i % 7, x.tolist()) for i, x in enumerate(p)], "cell int, posterior array<double>")
    got = {(r.cell, r.pattern): r.score for r in stats.hex_pattern(df, spark.createDataFrame(table, "component int, pattern string, score double"), ["cell"]).collect()}
    want = {(c, g): sum(p[np.arange(60) % 7 == c].mean(0)[k] * plain[k, g] for k in range(3)) for c in range(7) for g in groups}
    assert got == pytest.approx(want)


def test_the_pool_is_scored_by_the_best_model(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(-1, 1, (300, 2))
    label = (x[:, 0] * x[:, 1] > 0).astype(int)  # no line parts these
    df = spark.createDataFrame([(i, *map(float, v), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))], "id int, a double, b double, label int")
    train, test, pool = df.where("id < 200"), df.where("id between 200 and 249"), df.where("id >= 200")
    scored, best = stats.score_pool(train, test, pool, df.where("id in (3, 201)"), ["a", "b"], "label", "id", ("logistic", "forest"))
    got = {r.id: r.p for r in scored.collect()}
    assert best == "forest" and set(got) == {3, *range(200, 300)} and got[3] == got[201] == 0
    assert np.mean([(got[i] > 0.5) == label[i] for i in range(202, 300)]) > 0.85
