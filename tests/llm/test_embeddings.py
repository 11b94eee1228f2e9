"""Embedding links: the exact way against brute force, recall of the usual one, hot buckets."""

import numpy as np
import pytest

from terrapix.llm import embeddings


def near_pairs(n, dim, seed, low=0.975, high=1.0):
    """Random unit vectors and a partner of each at a cosine between the bounds."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])


def brute(v, labels, threshold=0.98):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    return link


def found(spark, v, labels, **more):
    df = spark.createDataFrame([(i, x.tolist(), int(g)) for i, (x, g) in enumerate(zip(v, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    return {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link_embeddings(df, 0.98, **more).collect()}


@pytest.mark.parametrize("hot", [4096, 40])
def test_the_exact_way_finds_every_link(spark, hot):
    v = near_pairs(250, 128, 1)
    labels = np.arange(len(v)) % 250 % 3
    link = brute(v, labels)
    got = found(spark, v, labels, within=64, radius=64, hot=hot)
    assert [got[i][0] for i in range(len(v))] == link.sum(1).tolist()
    assert all(got[i][1] == min([i, *np.flatnonzero(link[i])]) for i in range(250))


def test_recall_of_the_usual_way(spark):
    v = near_pairs(300, 64, 2, low=0.98)
    labels = np.zeros(len(v), int)
    usual = sum(x[0] for x in found(spark, v, labels).values())
    assert usual >= 0.9 * brute(v, labels).sum()


def test_tables_of_every_width_meet_as_they_promise():
    rng = np.random.default_rng(3)
    for within in (3, 7, 12, 40, 64):
        tables = embeddings.Tables(64, 10_000, within)
        for bits in range(0, within + 1):
            apart = np.array([sum(1 << int(k) for k in rng.choice(64, bits, replace=False)) for _ in range(50)], np.uint64)
            assert (tables.first(apart) >= 0).all()
