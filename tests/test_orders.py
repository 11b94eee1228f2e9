"""Sums along orders under many weights: brute force with ties, nulls and NaN, over many blocks and buckets."""

import numpy as np
import pytest

from terrapix.operators import orders, synergy

KIND = "id string, u1 double, u2 double, u3 double, area_m2 double"


@pytest.mark.parametrize("kernel", ["decreasing", "increasing"])
def test_efficiencies_under_many_weights_shuffle_no_rows_by_weight(spark, monkeypatch, kernel):
    for name, value in (("PLACES", 15 * 40), ("BUCKET", 50), ("SAMPLE", 200)):
        monkeypatch.setattr(orders, name, value)
    rng = np.random.default_rng(1)
    u = np.round(rng.normal(size=(330, 3)), 1)  # many ties
    u[:150, 0] = 0.3  # one great tie under the first weight
    rows = [[f"k{i:03d}", *map(float, x), float(a)] for i, (x, a) in enumerate(zip(u, rng.uniform(1e4, 9e4, 330), strict=True))]
    rows[7][1] = rows[90][3] = rows[31][4] = None
    rng.shuffle(rows)
    grid = synergy.lambda_grid(spark, 4)
    out = synergy.evaluate_lambdas(spark.createDataFrame(rows, KIND).repartition(3), grid, ["u1", "u2", "u3"], "id", kernel)
    assert "lam_id" not in "".join(p.split(")")[0] for p in out._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:])
    got = {r.lam_id: r for r in out.collect()}
    assert len(got) == 15
    ha = sum(r[4] / 1e4 for r in rows if r[4] is not None)
    for w in grid.collect():
        score = lambda r: None if None in r[1:4] else w.l1 * r[1] + w.l2 * r[2] + w.l3 * r[3]  # noqa: E731, B023
        order = sorted(rows, key=lambda r: (score(r) is None, -(score(r) or 0.0), r[0]))
        share = [(k + 0.5) / len(rows) for k in range(len(rows))]
        for c in (1, 2, 3):
            heavy = [1 - s if kernel == "decreasing" else s for s in share]
            assert got[w.lam_id][f"kernel_u{c}"] == pytest.approx(sum(r[c] * h / len(rows) for r, h in zip(order, heavy, strict=True) if r[c] is not None), abs=1e-12)
            placed = sum(r[c] * r[4] / 1e4 * (1 - s) for r, s in zip(order, share, strict=True) if None not in (r[c], r[4]))
            assert got[w.lam_id][f"perf_u{c}"] == pytest.approx(placed / ha, abs=1e-12)


def test_nan_and_infinity_come_last_and_first():
    u = np.array([[1.0], [np.nan], [np.inf], [0.0], [-0.0], [-np.inf], [-5.0], [9.0]])
    code = orders.codes(u, np.array([True] * 7 + [False]), np.array([1.0]))
    assert list(np.argsort(code, kind="stable")) == [2, 0, 3, 4, 6, 5, 1, 7] and code[3] == code[4]
    assert (orders.unpacked(orders.packed(np.sort(code))) == np.sort(code)).all()


def test_no_rows_and_unknown_kernels(spark):
    none = spark.createDataFrame([], KIND)
    assert synergy.evaluate_lambdas(none, synergy.lambda_grid(spark, 2), ["u1", "u2", "u3"], "id").collect() == []
    with pytest.raises(ValueError):
        synergy.evaluate_lambdas(none, synergy.lambda_grid(spark, 2), ["u1", "u2", "u3"], "id", "gaussian")
