"""Nearest neighbours, polygons and lines: brute force, dense towns, repeated places and very long outlines."""

import numpy as np
import pytest

from terrapix.operators import cover, kdtree, spatial


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAF", 16), ("SAMPLE", 256), ("TARGETS", 11), ("PLACE_PARTS", 3)):
        monkeypatch.setattr(spatial, name, value)
    monkeypatch.setattr(kdtree, "MOST_PAIRS", 64)


def points(spark, x, key):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{key} int, lon double, lat double")


def brute(tgt, src, k):
    d2 = ((tgt[:, None] - src[None]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(np.arange(len(src)), d2.shape), d2), axis=1)[:, :k]
    return {i: [(int(s), d2[i, s]) for s in order[i]] for i in range(len(tgt))}


@pytest.mark.parametrize("k", [1, 4])
def test_repeated_places_towns_and_targets_outside(spark, small, k):
    rng = np.random.default_rng(3)
    src = np.concatenate([np.round(rng.normal(size=(200, 2)), 1), np.full((150, 2), 7.0), rng.normal(size=(60, 2)) * 50])
    tgt = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) * 80, np.full((90, 2), 6.5), [[7.0, 7.0]]])
    have = {}
    for r in spatial.nearest(points(spark, tgt, "t"), points(spark, src, "s"), "t", "s", [], k).collect():
        have.setdefault(r.t, []).append((r["rank"], r.s, r.d2))
    want = brute(tgt, src, k)
    assert {t: [(s, d) for _, s, d in sorted(v)] for t, v in have.items()} == want


def test_fewer_sources_than_asked_and_values_of_other_types(spark):
    src = spark.createDataFrame([("b", 0.0, 0.0, None, "x"), ("a", 0.0, 0.0, 4, "é"), ("c", None, 1.0, 5, "z")], "s string, lon double, lat double, n long, word string")
    got = spatial.nearest(points(spark, [[1.0, 1.0]], "t"), src, "t", "s", ["n", "word"], 3).orderBy("rank").collect()
    assert [(r.s, r.n, r.word, r["rank"]) for r in got] == [("a", 4, "é", 1), ("b", None, "x", 2)]


@pytest.mark.parametrize("k", [1, 10])
def test_pairs_examined_around_a_dense_town(k):
    """Half of the sources in a town, targets around it: under 64 k pairs a target."""
    rng = np.random.default_rng(4)
    src = np.concatenate([rng.normal(size=(50_000, 2)) * 0.001, rng.uniform(-1, 1, size=(50_000, 2))])
    angle = rng.uniform(0, 6.3, 2000)
    tgt = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(0.003, 0.05, (2000, 1))
    leaf = kdtree.Leaf(src, np.arange(len(src)), k)
    row, point, d2 = leaf.search(tgt, k, np.full(len(tgt), np.inf))
    assert leaf.examined < 64 * k * len(tgt) and (np.bincount(row) == k).all()
    some = rng.integers(0, len(tgt), 50)
    for t in some:
        far = ((src - tgt[t]) ** 2).sum(1)
        assert np.allclose(np.sort(far)[:k], d2[row == t])


def plain_inside(p, sides):
    """Even-odd by a ray to the right; on a side is outside."""
    x, y = p[:, 0, None], p[:, 1, None]
    x1, y1, x2, y2 = sides.T
    with np.errstate(divide="ignore", invalid="ignore"):
        odd = (((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum(1) % 2 == 1
    on = ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
    return odd & ~on.any(1)


def outline(n, seed, scale=1.0, rough=0.05):
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = scale * (1 + 0.3 * np.sin(7 * angle) + rough * rng.normal(size=n))
    return np.stack([r * np.cos(angle) + 10, r * np.sin(angle) - 3], 1)


def polygon_frame(spark, rows):
    kind = "name string, rings array<array<struct<x: double, y: double>>>"
    return spark.createDataFrame([(n, None if rings is None else [[(float(a), float(b)) for a, b in r] for r in rings]) for n, rings in rows], kind)


@pytest.mark.parametrize("few", [20_000, 0])
def test_polygons_with_holes_crossings_and_points_on_sides(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW_CELLS", few)
    monkeypatch.setattr(spatial, "HOT_CELL", 50)
    shapes = {
        "ring": [outline(300, 1), outline(40, 2, 0.4)],
        "square": [np.array([[9, -4], [11, -4], [11, -2], [9, -2], [9, -4]])],
        "bow": [np.array([[8.5, -3.5], [9.5, -2.5], [9.5, -3.5], [8.5, -2.5]])],
        "far": [outline(5, 3) + 500],
    }
    rng = np.random.default_rng(5)
    grid = np.stack(np.meshgrid(np.linspace(8, 12, 17), np.linspace(-5, -1, 17)), 2).reshape(-1, 2)
    p = np.concatenate([rng.uniform([8, -5], [12, -1], (900, 2)), grid, shapes["ring"][0][:20], np.full((200, 2), [10.7, -3.1])])
    df = points(spark, p, "id").union(spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0)], "id int, lon double, lat double"))
    frame = polygon_frame(spark, [*shapes.items(), ("none", None), ("empty", [[]])])
    got = {(r.id, r.name) for r in spatial.points_in_polygons(df, frame, ["name"], sides=4).collect()}
    want = {(int(i), n) for n, rings in shapes.items() for i in np.flatnonzero(plain_inside(p, np.concatenate([np.concatenate([r, np.roll(r, -1, 0)], 1) for r in map(np.asarray, rings)])))}
    assert got == want


def test_a_cover_of_100_000_sides_has_few_sides_a_cell():
    ring = outline(100_000, 6, rough=3e-5)
    sides = np.concatenate([ring, np.roll(ring, -1, 0)], 1)
    cells = list(cover.cover_of(sides))
    border = [c for c in cells if len(c[4])]
    assert np.mean([len(c[4]) for c in border]) <= cover.SIDES and max(len(c[4]) for c in border) <= cover.MOST_SIDES and len(border) < len(sides)
    assert len({(c[0], c[1], c[2]) for c in cells}) == len(cells)
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(8, 12, (300, 2)) - [0, 13], ring[rng.integers(0, len(ring), 300)] + rng.normal(size=(300, 2)) * 0.01])
    where = {(c[0], c[1], c[2]): c for c in cells}
    for x, y in p:
        met = [c for level in {c[0] for c in cells} if (c := where.get((level, int(np.floor(x * 2**level / cover.TOP)), int(np.floor(y * 2**level / cover.TOP)))))]
        inside = False
        if met:
            ((level, ix, iy, ref, own),) = met
            size = cover.TOP / 2**level
            inside = ref ^ cover._odd(own, (ix + cover.AT_X) * size, (iy + cover.AT_Y) * size, x, y)
        assert inside == plain_inside(np.array([[x, y]]), sides)[0]


def test_distance_to_segments_against_brute_force(spark, small):
    rng = np.random.default_rng(9)
    start = rng.uniform([-120, 26], [-70, 48], (120, 2))
    ends = np.concatenate([start + rng.normal(size=(120, 2)) * 0.2, [[-60.0, 50.0], [-100.0, 30.0]]])
    lines = np.concatenate([np.concatenate([start, [[-125.0, 25.0], [-100.0, 30.0]]]), ends], 1)  # one across all, one point
    tgt = rng.uniform([-125, 25], [-65, 50], (200, 2))
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(lines)] + [(999, None, 1.0, 1.0, 1.0)], "line int, x1 double, y1 double, x2 double, y2 double")
    got = {r.t: (r.line, r.metres) for r in spatial.distance_to_lines(points(spark, tgt, "t"), frame, "t", "line").collect()}
    flat = lambda p: np.stack([6371000.0 * np.radians(p[:, 0]), 6371000.0 * np.sin(np.radians(p[:, 1]))], 1)
    a, b, p = flat(lines[:, :2]), flat(lines[:, 2:]), flat(tgt)
    d = b - a
    t = np.clip(((p[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    far = np.sqrt(((p[:, None] - (a + t[:, :, None] * d)) ** 2).sum(2))
    for i in range(len(tgt)):
        assert got[i][0] == far[i].argmin() and abs(got[i][1] - far[i].min()) < 1e-6


@pytest.mark.parametrize("k", [1, 3])
def test_targets_that_share_places_are_looked_up_once(spark, small, monkeypatch, k):
    kept, real = {}, spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    rng = np.random.default_rng(11)
    src, spots = rng.normal(size=(120, 2)), np.concatenate([rng.normal(size=(40, 2)) * 2, [[0.0, 0.0], [-0.0, 0.0]]])
    tgt = spots[rng.integers(0, len(spots), 500)]
    frame = points(spark, tgt, "t").union(spark.createDataFrame([(900, None, 1.0)], "t int, lon double, lat double"))
    have = {}
    for r in spatial.nearest(frame, points(spark, src, "s"), "t", "s", [], k).collect():
        have.setdefault(r.t, []).append((r["rank"], r.s, r.d2))
    assert {t: [(s, d) for _, s, d in sorted(v)] for t, v in have.items()} == brute(tgt, src, k)
    assert kept["asked"].count() <= 42


def test_equal_segments_are_cut_once(spark, small, monkeypatch):
    kept, real = {}, spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    lines = spark.createDataFrame([(i, 0.0, float(i % 2), 1.0, float(i % 2)) for i in range(7, 27)], "line int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.distance_to_lines(points(spark, [[0.5, -1.0], [0.5, 3.0]], "t"), lines, "t", "line").collect()
    assert {r.t: r.line for r in got} == {0: 8, 1: 7} and kept["lines"].count() == 2
