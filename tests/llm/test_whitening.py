"""Whitening against plain numpy, and its edge cases."""

import numpy as np
import pytest

from terrapix.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, components=32):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, x.shape[1])
    return ((n * x - sums) ** 2).sum(1), centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = plain([r.embedding for r in rows])
    got = queries.op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * len(rows) and got["n"].eq(len(rows)).all()
    assert (got["deviation"].to_numpy().reshape(-1, 32) == deviation[:, None]).all()
    mine = got["whitened"].to_numpy().reshape(-1, 32)
    signs = np.sign((mine * white).sum(0))
    np.testing.assert_allclose(mine * signs, white, atol=1e-9)
    np.testing.assert_allclose(got["explained"].to_numpy().reshape(-1, 32), np.tile(explained, (len(rows), 1)), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_many_blocks_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 3)
    monkeypatch.setattr(whitening, "TASK_ENTRIES", 100)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(101, 10)) @ rng.normal(size=(10, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.whiten_embeddings(df, 6).toPandas().sort_values(["vec_id", "component"])
    deviation, white, _ = plain(vectors, 6)
    mine = got["whitened"].to_numpy().reshape(-1, 6)
    np.testing.assert_allclose(mine * np.sign((mine * white).sum(0)), white, atol=1e-9)
    assert [int(x) for x in got["deviation"][got["component"] == 1]] == deviation.tolist()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    short = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.0, -3.5]), (5, [1.5, 0.25])]
    long = [(6, [1.0, 0.0, 5.0]), (7, [2.0, 0.5, 5.0]), (8, [0.0, 4.0, 5.0]), (9, [3.0, 1.0, 5.0])]
    bad = [(10, None), (11, [1.0, None]), (12, [nan, 1.0]), (13, [inf, 1.0]), (14, []), (15, [-inf, 0.0])]
    df = spark.createDataFrame([(*r, 3, "x", 0.5) for r in short + long + bad], "vec_id long, embedding array<double>, n int, x string, index double")
    got = whitening.whiten_embeddings(df).collect()
    two, three = [r for r in got if r.n == 5], [r for r in got if r.n == 4]
    assert len(two) == 5 * 2 and len(three) == 4 * 3 and len(got) == 22
    assert {r.vec_id for r in got} == {1, 2, None, 5, 6, 7, 8, 9}
    mine = np.array([[r.whitened for r in two if r.component == c] for c in (1, 2)])
    assert np.abs(mine.sum(1)).max() < 1e-9
    flat = [r for r in three if r.component == 3]
    assert all(r.whitened is None and r.explained < 1e-12 for r in flat)  # a constant dimension
    assert max(r.identity_error for r in three) < 1e-9


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_without_spread(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = whitening.whiten_embeddings(df).collect()
    assert len(got) == 2 * len(vectors)
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
