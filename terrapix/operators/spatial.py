"""Spatial joins: point in polygon, nearest and k nearest neighbours, grid snapping and sampling."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .cover import SIDES, TOP, covers, within
from .kdtree import CHUNK, Boxes, Leaf, splitters

SAMPLE = 1 << 18
"""Sources from which the splitters of leaves are taken; they come to the driver."""
LEAF = 4096
"""Sources of a leaf, about; more where the tables have over 2**27 sources, as there are 2**15 leaves at most."""
TARGETS = 8192
"""Targets that one task looks up in a leaf."""
PLACE_PARTS = 64
FEW_CELLS = 20_000
"""Cells of a cover that are broadcast: with ``SIDES`` sides each about 10 MB."""
HOT_CELL = 1 << 16


def rectangles(df: DataFrame, lat_lo: str = "lat_lo", lat_hi: str = "lat_hi", lon_lo: str = "lon_lo", lon_hi: str = "lon_hi") -> DataFrame:
    """``df`` with ``rings``: one closed ring around each row's box."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(corner(lon_lo, lat_lo), corner(lon_hi, lat_lo), corner(lon_hi, lat_hi), corner(lon_lo, lat_hi), corner(lon_lo, lat_lo))
    return df.withColumn("rings", F.array(ring))


def points_in_polygons(points: DataFrame, polygons: DataFrame, keep: list[str], x: str = "lon", y: str = "lat", sides: int = SIDES) -> DataFrame:
    """Every point with the ``keep`` columns of each polygon that it lies within (its sides excluded; even-odd rule).

    Polygons are covered by quadtree cells (:mod:`cover`), which are split until few sides are left in each. A point meets
    the cells that hold it, one a level; an interior cell needs no test and a border cell one of its own sides only, row
    by row inside the JVM. A cover of up to ``FEW_CELLS`` cells is broadcast; else points are joined by cell, those of
    cells with over ``HOT_CELL`` points in parts. A point without both coordinates is in none.
    """
    cover = stored(covers(polygons, keep, sides), "cover")
    n = cover.count()
    levels = [r.level for r in cover.select("level").distinct().collect()]  # 17 at most
    there = (F.abs(x) < 1e9) & (F.abs(y) < 1e9)
    size = lambda c: F.lit(TOP) / F.pow(F.lit(2.0), c)
    cell = F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")).alias("level")
    keyed = points.where(there).select("*", cell).withColumns({"ix": F.floor(F.col(x) / size(F.col("level"))), "iy": F.floor(F.col(y) / size(F.col("level")))})
    by = ["level", "ix", "iy"]
    named = cover.select(*[F.col(c).alias(f"{c}_") for c in by], *[c for c in cover.columns if c not in by])
    same = [F.col(c) == F.col(f"{c}_") for c in by]
    if n <= FEW_CELLS:
        met = keyed.join(F.broadcast(named), same)
    else:
        hot = keyed.join(cover.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.ceil(F.count("*") / HOT_CELL).alias("parts_")).where("parts_ > 1")
        hot = F.broadcast(stored(hot, "hot"))  # a row for every HOT_CELL points and level at most
        part = F.pmod(F.xxhash64(x, y), F.coalesce("parts_", F.lit(1)))
        left = keyed.join(hot, by, "left").withColumn("part_", part).drop("parts_")
        right = cover.join(hot, by, "left").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts_", F.lit(1)) - 1)))
        right = right.select(*[F.col(c).alias(f"{c}_") for c in by], F.col("part_").alias("part__"), *[c for c in cover.columns if c not in by])
        met = left.join(right, [*same, F.col("part_") == F.col("part__")])
    hit = met.where(within(F.col(x), F.col(y)))
    return hit.select(*points.columns, *[F.col(f"poly_{c}").alias(c) for c in keep])


def clip_points(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Points that lie in any polygon, once each."""
    inside = points_in_polygons(points, polygons.select("rings"), []).select(key).distinct()
    return points.join(inside, key, "left_semi")


def label_points(points: DataFrame, polygons: DataFrame, key: str, name: str) -> DataFrame:
    """All points with the upper-cased name of their polygon (the first by name), null outside."""
    found = points_in_polygons(points.select(key, "lon", "lat"), polygons, [name])
    labels = found.groupBy(key).agg(F.min(F.upper(name)).alias(name))
    return points.join(labels, key, "left")


def aggregate_in_polygons(points: DataFrame, polygons: DataFrame, name: str, value: str) -> DataFrame:
    """Number of points and sum of a value by polygon; polygons without points have 0."""
    sums = points_in_polygons(points, polygons, [name]).groupBy(name).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    every = polygons.select(name).distinct()
    return every.join(sums, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def polygon_mask(points: DataFrame, layers: list[DataFrame], key: str) -> DataFrame:
    """``points`` with ``masked``: whether they lie in a polygon of any layer."""
    hits = reduce(lambda a, b: a.union(b), [points_in_polygons(points, x.select("rings"), []).select(key) for x in layers])
    return points.join(hits.distinct().withColumn("masked", F.lit(True)), key, "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def snap_to_grid(col: Column, origin: float, step: float) -> Column:
    """Nearest grid coordinate, halves to even."""
    return origin + F.rint((col - origin) / step) * step


def snap_nearest_trim(df: DataFrame, lat0: float, lon0: float, step: float, tolerance: float | None = None) -> DataFrame:
    """Rows moved to their nearest grid point; rows further away than the tolerance (the cell's diagonal by default) go."""
    tol = math.hypot(step, step) if tolerance is None else tolerance
    df = df.withColumns({"snap_lat": snap_to_grid(F.col("lat"), lat0, step), "snap_lon": snap_to_grid(F.col("lon"), lon0, step)})
    return df.where((F.abs(F.col("lat") - F.col("snap_lat")) <= tol) & (F.abs(F.col("lon") - F.col("snap_lon")) <= tol))


def equal_area_xy(lat: Column, lon: Column, radius: float = 6371000.0) -> tuple[Column, Column]:
    """Metres in a cylindrical equal-area projection."""
    return radius * F.radians(lon), radius * F.sin(F.radians(lat))


def _located(rows: DataFrame, tree: DataFrame, columns: list[str], depth: int) -> DataFrame:
    """``rows`` with ``leaf_``: the leaf of a k-d tree (one row of arrays ``axis_`` and ``value_``) that holds them."""
    rows = rows.crossJoin(F.broadcast(tree)).withColumn("leaf_", F.lit(1))
    at = F.array(*columns)
    for _ in range(depth):
        beyond = F.get(at, F.get("axis_", F.col("leaf_"))) >= F.get("value_", F.col("leaf_"))
        rows = rows.withColumn("leaf_", F.col("leaf_") * 2 + F.when(beyond, F.lit(1)).otherwise(F.lit(0)))
    return rows.withColumn("leaf_", F.col("leaf_") - (1 << depth)).drop("axis_", "value_")


def _first_of_places(sources: DataFrame, place: list[str], k: int) -> DataFrame:
    """The ``k`` first sources by key of every place, as no other source of a place is ever among the nearest. Places
    are counted, and one with many sources is ranked in parts first."""
    counts = sources.groupBy(*place).agg(F.count("*").alias("k_")).where(F.col("k_") > k)
    if counts.isEmpty():
        return sources
    part = F.pmod(F.xxhash64("s_"), F.lit(PLACE_PARTS))
    for by in ([*place, "part_"], place):
        sources = sources if "part_" in sources.columns else sources.withColumn("part_", part)
        sources = sources.withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy("s_"))).where(F.col("rn_") <= k)
    return stored(sources.drop("part_", "rn_"), "places")


def _dealt(asks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by leaf and part: a leaf that many targets ask is copied, and its targets are dealt over the copies."""
    parts = asks.groupBy("leaf_").agg(F.ceil(F.count("*") / TARGETS).alias("parts_"))
    parts = F.broadcast(parts)  # as many rows as leaves at most
    left = asks.join(parts, "leaf_").withColumn("part_", F.pmod(F.xxhash64("t_"), F.col("parts_"))).drop("parts_")
    right = sources.join(parts, "leaf_").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_").cast("long") - 1))).drop("parts_")
    return left, right


def _stacked(a: pa.Array | pa.ChunkedArray, b: pa.Array | pa.ChunkedArray) -> pa.ChunkedArray:
    parts = [c for x in (a, b) for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]
    return pa.chunked_array(parts, a.type)


def nearest(
    targets: DataFrame,
    sources: DataFrame,
    target_key: str,
    source_key: str,
    keep: list[str],
    k: int = 1,
    axes: tuple[str, ...] = ("lon", "lat"),
    parts: dict[str, str] | None = None,
) -> DataFrame:
    """(target_key, source_key, keep..., d2, rank) of the ``k`` nearest sources of every target, ties by source key.

    Sources are cut into the leaves of a k-d tree, whose splitters are medians of a sample (``SAMPLE`` rows at most; it
    only tells how rows are dealt). A target is looked up in its own leaf, which gives a first bound; after that only
    leaves whose boxes are within the bound are asked. Inside a leaf a small tree does the same. A leaf that many targets
    ask is copied for parts of them, and of sources at one place only the first ``k`` count, so dense towns and repeated
    places cost no more than others. Where targets share places (by an estimate, two or more a place), each place is looked
    up once and joined to its targets. Sources and targets with a null coordinate are left out; fewer than ``k`` sources
    give fewer rows. Keys are numbers or texts; target keys are not repeated.

    With ``parts``, names of the columns ax, ay, bx, by (a segment) and cx, cy, dx, dy (the part of it that a row stands for),
    sources are line segments cut into short parts; distances are those to whole segments, and ``k`` is 1.
    """
    if parts:
        sources = sources.withColumns({a: (F.col(parts[f"c{a}"]) + F.col(parts[f"d{a}"])) / 2 for a in axes})
    known = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in axes]))
    at = lambda p: [F.col(c).cast("double").alias(f"{p}{i}_") for i, c in enumerate(axes)]
    src = known(sources).select(F.col(source_key).alias("s_"), *at("s"), *[F.col(parts[c]).alias(f"g_{c}") for c in parts or {}], *[F.col(c).alias(f"v_{c}") for c in keep])
    left = known(targets).select(F.col(target_key).alias("t_"), *at("t"))
    sc, tc, dims = [f"s{i}_" for i in range(len(axes))], [f"t{i}_" for i in range(len(axes))], len(axes)
    names = ["t_", "s_", *[f"v_{c}" for c in keep], "d2"]
    every, (asking, places) = left, left.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*tc))).first()
    shared = asking >= 2 * places > 0
    left = stored(every.groupBy(*tc).agg(F.min("t_").alias("t_")).select("t_", *tc), "asked") if shared else every
    shape = [f"g_{c}" for c in parts] if parts else sc
    src = _first_of_places(stored(src, "sources"), shape, k)
    n = src.count()
    depth = max(0, min((n // LEAF).bit_length(), (SAMPLE // 8).bit_length() - 1)) if n > LEAF else 0
    seen = src.where(F.pmod(F.xxhash64("s_"), F.lit(max(n, 1))) < SAMPLE).select(*sc).limit(2 * SAMPLE)
    axis, value = splitters(seen.toPandas().to_numpy(np.float64).reshape(-1, dims), depth) if depth else ([0], [0.0])
    spark = src.sparkSession
    tree = spark.createDataFrame([(axis, value)], "axis_ array<int>, value_ array<double>")
    held = _located(src, tree, sc, depth)
    held = stored(held, "leaves") if depth else held
    low, high, count = np.full((1 << depth, dims), np.inf), np.full((1 << depth, dims), -np.inf), np.zeros(1 << depth, np.int64)
    low_of = [F.least(f"g_c{a}", f"g_d{a}") for a in axes] if parts else [F.col(c) for c in sc]
    high_of = [F.greatest(f"g_c{a}", f"g_d{a}") for a in axes] if parts else [F.col(c) for c in sc]
    ends = held.groupBy("leaf_").agg(F.count("*").alias("n"), *[f(c[i]).alias(f"{p}{i}") for i in range(dims) for p, f, c in (("lo", F.min, low_of), ("hi", F.max, high_of))])
    for r in ends.collect():  # a row for every leaf
        count[r.leaf_], low[r.leaf_], high[r.leaf_] = r.n, [r[f"lo{i}"] for i in range(dims)], [r[f"hi{i}"] for i in range(dims)]
    boxes = Boxes.of_leaves(low, high, count)

    def rows_of(t: pa.Table, s: pa.Table, row: np.ndarray, point: np.ndarray, d2: np.ndarray) -> dict:
        """Columns of pairs, with the types that they came with."""
        return {"t_": t["t_"].take(pa.array(row)), **{c: s[c].take(pa.array(point)) for c in names[1:-1]}, "d2": pa.array(d2)}

    def numbers(t: pa.Table, columns: list[str]) -> np.ndarray:
        return np.stack([t[c].to_numpy(zero_copy_only=False) for c in columns], 1).astype(np.float64).reshape(-1, len(columns))

    def leaf_of(s: pa.Table) -> Leaf:
        rank = np.empty(len(s), np.int64)
        rank[pc.sort_indices(s["s_"]).to_numpy()] = np.arange(len(s))
        if not parts:
            return Leaf(numbers(s, sc), rank, k)
        c, d = numbers(s, [f"g_c{a}" for a in axes]), numbers(s, [f"g_d{a}" for a in axes])
        return Leaf(numbers(s, sc), rank, k, np.minimum(c, d), np.maximum(c, d), numbers(s, ["g_ax", "g_ay", "g_bx", "g_by"]))

    def own(t: pa.Table, s: pa.Table) -> pa.Table:
        """The nearest of the own leaf, and a row for every other leaf within the bound that they give."""
        q, leaf = numbers(t, tc), t["leaf_"].to_numpy().astype(np.int64)
        r2 = boxes.bound(q, leaf, k)
        row, point, d2 = leaf_of(s).search(q, k, r2)
        full = np.bincount(row, minlength=len(q)) == k
        last = np.zeros(len(q))
        np.maximum.at(last, row, d2)
        r2 = np.where(full, np.minimum(r2, last), r2)
        found = rows_of(t, s, row, point, d2)
        asks, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(a, min(a + CHUNK, len(q))) for a in range(0, len(q), CHUNK)]
        while todo:
            a, z = todo.pop()
            met = boxes.meeting(q[a:z], r2[a:z], k)
            if met is None:
                todo += [(a, (a + z) // 2), ((a + z) // 2, z)]
                continue
            r2[a:z] = met[3]
            other = met[1] != leaf[a:z][met[0]]
            asks.append(met[0][other] + a)
            to.append(met[1][other])
        asks, to = np.concatenate(asks), np.concatenate(to)
        asked = {"t_": t["t_"].take(pa.array(asks)), "d2": pa.array(r2[asks])}
        both = {c: _stacked(x, asked.get(c, pa.nulls(len(asks), x.type))) for c, x in found.items()}
        both |= {c: _stacked(pa.nulls(len(row), pa.float64()), pa.array(q[asks, i])) for i, c in enumerate(tc)}
        both["leaf_"] = _stacked(pa.nulls(len(row), pa.int32()), pa.array(to.astype(np.int32)))
        return pa.table(both)

    def other(t: pa.Table, s: pa.Table) -> pa.Table:
        return pa.table(rows_of(t, s, *leaf_of(s).search(numbers(t, tc), k, t["d2"].to_numpy().astype(np.float64))))

    by = ["leaf_", "part_"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.join(src, F.lit(False)).withColumn("d2", F.lit(0.0)).select(*names).schema)
    first, right = _dealt(_located(left, tree, tc, depth), held)
    first = first.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(own, f"{kind}, " + ", ".join(f"{c} double" for c in tc) + ", leaf_ int")
    found = first.select(*names)
    if depth:
        first = stored(first, "near")
        found = first.where("leaf_ is null").select(*names)
        asks, right = _dealt(first.where("leaf_ is not null").select("t_", *tc, "leaf_", "d2"), held)
        found = found.union(asks.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(other, kind))
    if k == 1:
        best = found.groupBy("t_").agg(F.min(F.struct("d2", *names[1:-1])).alias("b")).select("t_", *[f"b.`{c}`" for c in names[1:]]).withColumn("rank", F.lit(1))
    else:
        w = Window.partitionBy("t_").orderBy("d2", "s_")  # k rows for each leaf that a target has asked
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if shared:
        found = stored(left.join(best, "t_").select(*tc, *names[1:], "rank"), "found")  # a stored table's size is known: a small one is broadcast
        best = every.join(found, tc)
    return best.select(*names, "rank").toDF(target_key, source_key, *keep, "d2", "rank")


def fill_nonpositive_nearest(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Each column's values that are null or not positive, replaced by that of the nearest row with a positive one."""
    for c in columns:
        good = F.coalesce(F.col(c) > 0, F.lit(False))
        near = nearest(df.where(~good), df.where(good).withColumnRenamed(key, "source_"), key, "source_", [c])
        df = df.join(near.select(key, F.col(c).alias("new_")), key, "left").withColumn(c, F.coalesce("new_", c)).drop("new_")
    return df


def nearest_valid_sample(points: DataFrame, grid: DataFrame, variables: list[str], key: str, grid_key: str) -> DataFrame:
    """For every point and variable the value of the nearest grid row that has one."""
    out = points
    for v in variables:
        near = nearest(points, grid.where(F.col(v).isNotNull()), key, grid_key, [v])
        out = out.join(near.select(key, v), key, "left")
    return out


def idw_join(targets: DataFrame, sources: DataFrame, columns: list[str], key: str, source_key: str, k: int = 10, power: float = 2.0) -> DataFrame:
    """Weighted means of the ``k`` nearest sources, weights 1 / max(d, 1e-10) ** power."""
    near = nearest(targets, sources, key, source_key, columns, k)
    w = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-10)), F.lit(power))
    near = near.withColumn("w_", w)
    return near.groupBy(key).agg(*[(F.sum(F.col("w_") * F.col(c)) / F.sum("w_")).alias(c) for c in columns])


def distance_to_features(cells: DataFrame, features: DataFrame, key: str, feature_key: str) -> DataFrame:
    """Metres from every cell to the nearest feature point, in an equal-area projection."""

    def flat(df: DataFrame, k: str) -> DataFrame:
        x, y = equal_area_xy(F.col("lat"), F.col("lon"))
        return df.select(k, x.alias("x"), y.alias("y"))

    near = nearest(flat(cells, key), flat(features, feature_key), key, feature_key, [], axes=("x", "y"))
    return near.select(key, F.sqrt("d2").alias("metres"))


def cut_lines(lines: DataFrame, keep: list[str], longest: float) -> DataFrame:
    """Segments (ax, ay, bx, by) with ``keep``, cut into parts (cx, cy, dx, dy) of at most ``longest``: a row each."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2) / longest)).cast("int")
    parts = lines.withColumn("n_", n).withColumn("i_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    at = lambda axis, i: F.col(f"a{axis}") + (F.col(f"b{axis}") - F.col(f"a{axis}")) * (i / F.col("n_"))
    ends = [at(axis, F.col("i_") + step).alias(f"{name}{axis}") for name, step in (("c", 0), ("d", 1)) for axis in "xy"]
    return parts.select(*keep, "ax", "ay", "bx", "by", *ends)


def distance_to_lines(cells: DataFrame, lines: DataFrame, key: str, line_key: str, parts: int = 4) -> DataFrame:
    """Metres from every cell to the nearest place on line segments (x1, y1, x2, y2 in degrees), straight in an equal-area
    projection, and the segment's key (the least of ties).

    Segments are cut into parts, about ``parts`` times as many as there are segments and each no longer than that asks
    for, which are dealt and looked up like points; the distance is the exact one to the segment. Equal segments are cut
    once, under their least key. Segments with a null are left out.
    """
    (ax, ay), (bx, by) = (equal_area_xy(F.col(f"y{i}"), F.col(f"x{i}")) for i in (1, 2))
    flat = lines.na.drop(subset=["x1", "y1", "x2", "y2"]).select(line_key, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    flat = stored(flat.groupBy("ax", "ay", "bx", "by").agg(F.min(line_key).alias(line_key)), "lines")
    size = flat.agg(F.count("*").alias("n"), F.sum(F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)).alias("m")).first()
    cut = cut_lines(flat, [line_key], max((size.m or 0.0) / max(1, parts * size.n), 1e-3))
    x, y = equal_area_xy(F.col("lat"), F.col("lon"))
    columns = {c: c for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")}
    near = nearest(cells.select(key, x.alias("x"), y.alias("y")), cut, key, line_key, [], axes=("x", "y"), parts=columns)
    return near.select(key, line_key, F.sqrt("d2").alias("metres"))


def sample_grid(points: DataFrame, grid: DataFrame, value: str, lat0: float, lon0: float, dlat: float, dlon: float, method: str = "nearest") -> DataFrame:
    """``points`` with ``sampled``: the grid's value at their place, of the nearest cell or bilinear from four.

    The grid has lat_idx and lon_idx; a point whose cells are not all there has null.
    """
    fy, fx = (F.col("lat") - lat0) / dlat, (F.col("lon") - lon0) / dlon
    cells = grid.select(F.col("lat_idx").alias("gi_"), F.col("lon_idx").alias("gj_"), F.col(value).alias("gv_"))
    if method == "nearest":
        asked = points.withColumns({"gi_": F.rint(fy).cast("long"), "gj_": F.rint(fx).cast("long")})
        return asked.join(cells, ["gi_", "gj_"], "left").select(*points.columns, F.col("gv_").alias("sampled"))
    iy, ix = F.floor(fy + 1e-9).cast("long"), F.floor(fx + 1e-9).cast("long")
    out = points.withColumns({"iy_": iy, "ix_": ix, "wy_": F.greatest(fy - iy, F.lit(0.0)), "wx_": F.greatest(fx - ix, F.lit(0.0))})
    corners = []
    for a in (0, 1):
        for b in (0, 1):
            c = cells.select((F.col("gi_") - a).alias("iy_"), (F.col("gj_") - b).alias("ix_"), F.col("gv_").alias(f"c{a}{b}_"))
            out = out.join(c, ["iy_", "ix_"], "left")
            corners.append(F.col(f"c{a}{b}_") * (F.col("wy_") if a else 1 - F.col("wy_")) * (F.col("wx_") if b else 1 - F.col("wx_")))
    return out.select(*points.columns, reduce(lambda p, q: p + q, corners).alias("sampled"))


def resample_grid(src: DataFrame, dst: DataFrame, value: str, lat0: float, lon0: float, dlat: float, dlon: float, method: str = "nearest", mask: DataFrame | None = None, key: str = "pixel_id") -> DataFrame:
    """Values of ``src`` on the cells of ``dst``; with ``mask`` only on its cells."""
    cells = dst if mask is None else dst.join(mask.select(key), key, "left_semi")
    return sample_grid(cells, src, value, lat0, lon0, dlat, dlon, method)


def ring_fill(hexes: DataFrame, column: str, radius: int = 5) -> DataFrame:
    """Null values of axial hex cells (q, r) filled by the nearest ring's first valid neighbour (by q, then r)."""
    offsets = [
        (dq, dr, max(abs(dq), abs(dr), abs(dq + dr))) for dq in range(-radius, radius + 1) for dr in range(-radius, radius + 1) if 0 < max(abs(dq), abs(dr), abs(dq + dr)) <= radius
    ]
    ring = F.explode(F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr"), F.lit(c).alias("ring")) for a, b, c in offsets]))
    gaps = hexes.where(F.col(column).isNull()).select("q", "r", ring.alias("o"))
    gaps = gaps.select(F.col("q").alias("q0"), F.col("r").alias("r0"), (F.col("q") + F.col("o.dq")).alias("q"), (F.col("r") + F.col("o.dr")).alias("r"), F.col("o.ring").alias("ring"))
    valid = hexes.where(F.col(column).isNotNull()).select("q", "r", F.col(column).alias("v"))
    best = gaps.join(valid, ["q", "r"]).groupBy("q0", "r0").agg(F.min_by("v", F.struct("ring", "q", "r")).alias("new_"))
    best = best.select(F.col("q0").alias("q"), F.col("r0").alias("r"), "new_")
    return hexes.join(best, ["q", "r"], "left").withColumn(column, F.coalesce(column, "new_")).drop("new_")
