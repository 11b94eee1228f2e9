"""Quadtree covers of polygons: cells that lie inside, and border cells with the few sides that meet them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 1024.0
"""Side of a cell of level 0; a cell of level l has TOP / 2**l."""
MAX_LEVEL = 32
SIDES = 12
"""Sides up to which a border cell is not split; sides that share a point may be more in the smallest cells."""
MOST_SIDES, SPREAD = 256, 4
"""A cell with that many sides at most is not split either if its parts would have over ``SPREAD`` times as many in all:
its sides are long and cross each other."""
AT_X, AT_Y = 2**0.5 - 1, 2.718281828459045 - 2
"""Where in a cell its reference point is: at places that round coordinates do not have."""
COVER = "level int, ix long, iy long, inside boolean, x1 array<double>, y1 array<double>, x2 array<double>, y2 array<double>"


def edges(rings: Column) -> Column:
    """Sides of all rings as structs of x1, y1, x2, y2; an open ring is closed."""

    def sides(ring: Column) -> Column:
        after = lambda i: F.get(ring, (i + 1) % F.size(ring))
        return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), after(i)["x"].alias("x2"), after(i)["y"].alias("y2")))

    return F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), sides))


def _odd(sides: np.ndarray, rx: float, ry: float, px: float, py: float) -> bool:
    """Whether the way from (rx, ry) up or down to py and then along to px crosses the sides an odd number of times."""
    x1, y1, x2, y2 = sides.T
    with np.errstate(divide="ignore", invalid="ignore"):
        up = ((x1 > rx) != (x2 > rx)) & ((ry < (y2 - y1) * (rx - x1) / (x2 - x1) + y1) != (py < (y2 - y1) * (rx - x1) / (x2 - x1) + y1))
        along = ((y1 > py) != (y2 > py)) & ((rx < (x2 - x1) * (py - y1) / (y2 - y1) + x1) != (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1))
    return bool((up.sum() + along.sum()) % 2)


def _meets(sides: np.ndarray, x: float, y: float, size: float) -> np.ndarray:
    """Whether each side meets the closed square, with a margin for rounding."""
    x1, y1, x2, y2 = sides.T
    e = size * 1e-9 + 1e-12
    box = (np.maximum(x1, x2) >= x - e) & (np.minimum(x1, x2) <= x + size + e) & (np.maximum(y1, y2) >= y - e) & (np.minimum(y1, y2) <= y + size + e)
    dx, dy = x2 - x1, y2 - y1
    middle = dx * (y + size / 2 - y1) - dy * (x + size / 2 - x1)
    reach = (np.abs(dx) + np.abs(dy)) * (size / 2 + e)
    return box & (np.abs(middle) <= reach * (1 + 1e-9))


def cover_of(sides: np.ndarray, most: int = SIDES) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(level, ix, iy, whether the reference point is inside, sides) of the cells that cover a polygon.

    A cell with more than ``most`` sides is split into 4 x 4. Whether a child's reference point is inside follows from
    its parent's and from the parent's sides that the way between the two crosses; a cell without sides is all
    inside or all outside, and is given in the first case only.
    """
    if not len(sides):
        return
    low, high = sides.reshape(-1, 2).min(0), sides.reshape(-1, 2).max(0)
    span = max(float((high - low).max()), TOP / 2**MAX_LEVEL)
    level = max(0, min(MAX_LEVEL, int(np.floor(np.log2(TOP / span)))) // 2 * 2)
    size, todo = TOP / 2**level, []
    x1, y1, x2, y2 = sides.T
    for ix in range(int(np.floor(low[0] / size)), int(np.floor(high[0] / size)) + 1):
        for iy in range(int(np.floor(low[1] / size)), int(np.floor(high[1] / size)) + 1):
            rx, ry = (ix + AT_X) * size, (iy + AT_Y) * size
            with np.errstate(divide="ignore", invalid="ignore"):
                right = ((y1 > ry) != (y2 > ry)) & (rx < (x2 - x1) * (ry - y1) / (y2 - y1) + x1)
            todo.append((level, ix, iy, bool(right.sum() % 2), sides[_meets(sides, ix * size, iy * size, size)]))
    while todo:
        level, ix, iy, inside, own = todo.pop()
        if not len(own):
            if inside:
                yield level, ix, iy, True, own
            continue
        if len(own) <= most or level >= MAX_LEVEL:
            yield level, ix, iy, inside, own
            continue
        size = TOP / 2**level
        rx, ry, part = (ix + AT_X) * size, (iy + AT_Y) * size, size / 4
        children = [(jx, jy, own[_meets(own, jx * part, jy * part, part)]) for jx in range(4 * ix, 4 * ix + 4) for jy in range(4 * iy, 4 * iy + 4)]
        if len(own) <= MOST_SIDES and sum(len(c[2]) for c in children) > SPREAD * len(own):
            yield level, ix, iy, inside, own
            continue
        for jx, jy, met in children:
            there = inside ^ _odd(own, rx, ry, (jx + AT_X) * part, (jy + AT_Y) * part)
            todo.append((level + 2, jx, jy, there, met))


def covers(polygons: DataFrame, keep: list[str], most: int = SIDES) -> DataFrame:
    """The cells of all polygons with their ``keep`` columns as ``poly_<name>``. A polygon's row is covered by one task,
    which hands on its cells in parts."""
    asked = polygons.select(*[F.col(c).alias(f"poly_{c}") for c in keep], edges(F.col("rings")).alias("edges_")).withColumn("pid_", F.monotonically_increasing_id())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["pid_", *[x.split()[0] for x in COVER.split(", ")]]
        for b in batches:
            rows = []
            for pid, *ends in b.itertuples(index=False, name=None):
                sides = np.stack(ends, 1).astype(np.float64)
                sides = sides[(sides[:, :2] != sides[:, 2:]).any(1)]
                for level, ix, iy, inside, own in cover_of(sides, most):
                    rows.append((pid, level, ix, iy, inside, *own.T))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    ends = asked.where(F.size("edges_") > 0).select("pid_", *[F.col(f"edges_.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    cells = ends.mapInPandas(work, f"pid_ long, {COVER}")
    named = cells.join(asked.drop("edges_"), "pid_") if keep else cells
    return named.withColumn("edges_", F.arrays_zip("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2", "pid_")


def within(x: Column, y: Column) -> Column:
    """Whether a point of a cover's cell lies in its polygon; a point on a side does not."""
    size = F.lit(TOP) / F.pow(F.lit(2.0), F.col("level"))
    rx, ry = (F.col("ix") + AT_X) * size, (F.col("iy") + AT_Y) * size
    never = lambda c: F.coalesce(c, F.lit(False))
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))

    def crossings(e: Column) -> Column:
        yint = over((e["y2"] - e["y1"]) * (rx - e["x1"]), e["x2"] - e["x1"]) + e["y1"]
        xint = over((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        up = ((e["x1"] > rx) != (e["x2"] > rx)) & ((ry < yint) != (y < yint))
        along = ((e["y1"] > y) != (e["y2"] > y)) & ((rx < xint) != (x < xint))
        return never(up).cast("int") + never(along).cast("int")

    on = lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )
    odd = F.aggregate("edges_", F.lit(0), lambda acc, e: acc + crossings(e)) % 2 == 1
    return (F.size("edges_") == 0) | ((F.col("inside") != odd) & ~F.exists("edges_", on))
