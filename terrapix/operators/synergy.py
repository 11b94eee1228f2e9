"""Coupling coordination of objectives, weight grids, frontiers and carbon totals by scenario."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.tables import stored
from .orders import sums_along
from .quantiles import bounds_of, count_below, quantiles
from .ranking import ranked_prefix
from .series import crop_revenues, prices_by_crop, total_of


CHAMPIONS = 512
FRONT_RANGE = 1 << 15
"""Points of up to three columns that one task sweeps."""
RANGE = 8192
"""Points of a front that one task holds of one range."""
STEP = 512
MOST_WEIGHTS = 10_000
"""Weights that one evaluation takes; their table goes with its tasks."""


def ccd(columns: list[str], weights: list[float | Column] | None = None, form: str = "product") -> tuple[Column, Column, Column]:
    """Coupling C, benefit T and coordination sqrt(C * T) of objectives in 0..1.

    C is (product / mean ** n) ** (1 / n), or 1 / (1 + deviation / mean) for ``cv``; 0 where the mean is 0.
    """
    n = len(columns)
    u = [F.col(c) for c in columns]
    mean = reduce(lambda a, b: a + b, u) / n
    if form == "product":
        c = F.pow(reduce(lambda a, b: a * b, u) / F.pow(mean, F.lit(n)), F.lit(1 / n))
    else:
        sd = F.sqrt(reduce(lambda a, b: a + b, [(x - mean) ** 2 for x in u]) / n)
        c = 1 / (1 + sd / mean)
    c = F.when(mean == 0, 0.0).otherwise(c)
    w = [F.lit(1 / n)] * n if weights is None else [F.lit(x) if isinstance(x, (int, float)) else x for x in weights]
    t = reduce(lambda a, b: a + b, [a * b for a, b in zip(w, u, strict=True)])
    return c, t, F.sqrt(c * t)


def lambda_grid(spark, m: int, n: int = 3) -> DataFrame:
    """All weights (i, j, k) / m on the simplex of three objectives, numbered in order."""
    i = spark.range(m + 1).select(F.col("id").alias("i"))
    ij = i.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m) - F.col("i"))).alias("j"))
    number = F.col("i") * (m + 1) + F.col("j")
    return ij.select(number.cast("long").alias("lam_id"), (F.col("i") / m).alias("l1"), (F.col("j") / m).alias("l2"), ((m - F.col("i") - F.col("j")) / m).alias("l3"))


def grid_size(n: int) -> int:
    """Side of the grid for about ``n`` weights."""
    return int(math.sqrt(2 * n))


def dirichlet(spark, n: int, seed: int = 3) -> DataFrame:
    """``n`` seeded random weights on the simplex, by exponentials."""
    e = [-F.log(F.rand(seed + k)) for k in range(3)]
    rows = spark.range(n).select(F.col("id").alias("lam_id"), *[x.alias(f"e{k}") for k, x in enumerate(e)])
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return rows.select("lam_id", *[(F.col(f"e{k}") / total).alias(f"l{k + 1}") for k in range(3)])


def ccd_optimize(df: DataFrame, columns: list[str], mode: str = "global", gap: float = 1e-9, rounds: int = 60) -> DataFrame:
    """Weights on the simplex (l1, l2, ...) that give the greatest mean coordination, and the mean (ccd) and duality gap.

    The mean is concave in the weights. Every round is one aggregate: mean, gradient and second derivatives. The next
    weights are the maximum of that quadratic on the simplex, halved until the mean rises. The gap, the greatest entry of
    the gradient less its mean under the weights, bounds what could still be gained; rounds end when it is at most
    ``gap``. ``pixel`` chooses weights for each row instead; benefit is linear in them there, so the best objective gets all.
    """
    c, _, _ = ccd(columns)
    if mode == "pixel":
        return df.withColumn("ccd", F.sqrt(c * F.greatest(*columns)))
    n = len(columns)
    rows = df.select(*[F.col(x).cast("double").alias(f"u{i}_") for i, x in enumerate(columns)], c.alias("c_")).na.drop()
    u = [F.col(f"u{i}_") for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        benefit = F.greatest(reduce(lambda a, b: a + b, [x * float(v) for x, v in zip(u, w, strict=True)]), F.lit(1e-12))
        root = F.sqrt(F.greatest(F.col("c_"), F.lit(0.0)) * benefit)
        one = rows.select(*u, benefit.alias("b_"), root.alias("f_"))
        first = [F.avg(F.col("f_") * x / F.col("b_")) / 2 for x in u]
        second = [F.avg(F.col("f_") * u[i] * u[j] / (F.col("b_") * F.col("b_"))) / -4 for i, j in pairs]
        found = one.agg(F.avg("f_").alias("f"), *[x.alias(f"g{i}") for i, x in enumerate(first)], *[x.alias(f"h{i}_{j}") for x, (i, j) in zip(second, pairs, strict=True)]).first()
        hess = np.zeros((n, n))
        for i, j in pairs:
            hess[i, j] = hess[j, i] = found[f"h{i}_{j}"] or 0.0
        return found.f, np.array([found[f"g{i}"] or 0.0 for i in range(n)]), hess

    w = np.full(n, 1 / n)
    value, grad, hess = at(w)
    if value is None:
        return df.sparkSession.createDataFrame([], ", ".join(f"l{i + 1} double" for i in range(n)) + ", ccd double, gap double")
    for _ in range(rounds):
        if grad.max() - grad @ w <= gap:
            break
        step = simplex_step(w, grad, hess) - w
        while np.abs(step).max() > 1e-14:
            after = at(w + step)
            if after[0] >= value:
                break
            step = step / 2
        else:
            break
        w, (value, grad, hess) = w + step, after
    row = (*map(float, w), float(value), float(grad.max() - grad @ w))
    return df.sparkSession.createDataFrame([row], ", ".join(f"l{i + 1} double" for i in range(n)) + ", ccd double, gap double")


def simplex_step(w: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """The weights on the simplex that maximise the concave quadratic with this gradient and curvature at ``w``.

    Active set: a weight that would fall below 0 is fixed there, and one whose gradient exceeds those of the free ones
    is freed.
    """
    n, free, out = len(w), w > 0, w.copy()
    curve = hess - np.eye(n) * max(1e-14, 1e-12 * np.abs(hess).max())
    for _ in range(20 * n):
        idx = np.flatnonzero(free)
        lhs = np.zeros((len(idx) + 1, len(idx) + 1))
        lhs[:-1, :-1], lhs[:-1, -1], lhs[-1, :-1] = curve[np.ix_(idx, idx)], -1.0, 1.0
        rhs = np.append(-(grad - curve @ w)[idx], 1.0)
        want = np.zeros(n)
        want[idx] = np.linalg.lstsq(lhs, rhs, rcond=None)[0][:-1]
        below = free & (want < 0)
        if below.any():
            ratio = np.where(below, out / np.maximum(out - want, 1e-300), np.inf)
            k = int(ratio.argmin())
            out = np.maximum(out + ratio[k] * (want - out), 0.0)
            out[k], free[k] = 0.0, False
            continue
        out = want
        slope = grad + curve @ (out - w)
        gain = np.where(free, -np.inf, slope - slope[free].mean())
        if gain.max(initial=-np.inf) <= 1e-13:
            break
        free[int(gain.argmax())] = True
    return out / out.sum()


def evaluate_lambdas(df: DataFrame, grid: DataFrame, columns: list[str], key: str, kernel: str = "decreasing", area: str = "area_m2") -> DataFrame:
    """By weights: kernel (decreasing or increasing) and performance efficiencies of three objectives in the order of their
    weighted sum, then the key.

    Both are sums of values times a number that is linear in a row's place, which :func:`sums_along` adds up: only scores
    and places are shuffled for every weight, not rows.
    """
    if kernel not in ("decreasing", "increasing"):
        raise ValueError(f"kernel {kernel} is not linear in the place")
    weights = grid.limit(MOST_WEIGHTS + 1).collect()
    if len(weights) > MOST_WEIGHTS:
        raise ValueError(f"over {MOST_WEIGHTS} weights; evaluate them in parts")
    numbered = df.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(weights)], StructType([StructField("weight", IntegerType()), *grid.schema.fields]))
    ha, side = F.col(area) / 1e4, "late" if kernel == "decreasing" else "early"
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"k_{c}") for c in columns], *[(F.col(c) * ha).alias(f"p_{c}") for c in columns], ha.alias("ha"))
    own = [f"k_{c}" for c in columns]
    table = np.array([[w["l1"], w["l2"], w["l3"]] for w in weights], np.float64).reshape(-1, 3)
    sums = sums_along(rows, table, own, "key", [*own, *[f"p_{c}" for c in columns], "ha"], own if side == "early" else [])
    n = F.col("n")
    found = sums.join(F.broadcast(numbered), "weight")
    return found.select("lam_id", "l1", "l2", "l3", *[(F.col(f"{side}_k_{c}") / n / n).alias(f"kernel_{c}") for c in columns], *[(F.col(f"late_p_{c}") / n / F.col("sum_ha")).alias(f"perf_{c}") for c in columns])


def _dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each row of ``x`` whether a row of ``by`` is as great in every column and greater in one."""
    out = np.zeros(len(x), bool)
    for k in range(0, len(x), STEP):
        part = x[k : k + STEP]
        for j in range(0, len(by), STEP):
            left = np.flatnonzero(~out[k : k + STEP])
            a, b = part[left, None, :], by[None, j : j + STEP, :]
            out[k + left] |= ((b >= a).all(2) & (b > a).any(2)).any(1)
    return out


def swept(x: np.ndarray) -> np.ndarray:
    """Which of the distinct points ``x`` (up to three columns) no other one dominates, by merging halves of their order.

    In falling order only an earlier point can dominate. At every level the points of a block's later half meet the
    running maximum of the third column over those of its earlier half along the falling second column.
    """
    m = len(x)
    x = np.concatenate([x, np.zeros((m, 3 - x.shape[1]))], 1)
    order = np.lexsort((-x[:, 2], -x[:, 1], -x[:, 0]))
    second, third = x[order, 1], np.unique(x[order, 2], return_inverse=True)[1]
    alive, width = np.ones(m, bool), 1
    while width < m:
        idx = np.flatnonzero(alive)
        block, later = idx // (2 * width), idx // width % 2
        along = np.lexsort((later, -second[idx], block))
        seen = np.where(later == 0, third[idx], -1)[along] + block[along] * (m + 1)
        most = np.maximum.accumulate(seen) - block[along] * (m + 1)
        beaten = (later[along] == 1) & (most >= third[idx][along])
        alive[idx[along[beaten]]] = False
        width *= 2
    out = np.zeros(m, bool)
    out[order] = alive
    return out


def merged_front(points: DataFrame, names: list[str]) -> DataFrame:
    """The front of distinct ``points`` of up to three columns (greater is better).

    Ranges of the first column of about ``FRONT_RANGE`` points are swept, each in a task. Then 2, 4, 8, ... ranges become
    one: its lower half meets the upper half, of which the maximum of the third column counts at and above a value of the
    second. That maximum runs along ranges of the second column, within them by a window, across them by a small table.
    """
    kind = ", ".join(f"{n} double" for n in names)
    levels = min(12, max(0, (points.count() // FRONT_RANGE).bit_length()))

    def ranged(df: DataFrame, column: str, out: str) -> DataFrame:
        bounds = points.agg(bounds_of(F.col(column), levels).alias("q_"))
        return count_below(df.crossJoin(F.broadcast(bounds)), column, "q_", levels, out).drop("q_")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[swept(pdf[names].to_numpy(np.float64))]

    second, third = [F.col(n) if n in names else F.lit(0.0) for n in ("v1_", "v2_")]
    placed = ranged(points, names[0], "p_") if levels else points.withColumn("p_", F.lit(0))
    placed = placed.groupBy("p_").applyInPandas(lambda pdf: sweep(pdf)[[*names, "p_"]], f"{kind}, p_ int")
    if not levels:
        return placed.select(*names)
    placed = ranged(placed, "v1_", "s_") if "v1_" in names else placed.withColumn("s_", F.lit(0))
    placed = stored(placed.withColumns({"a_": second, "z_": third}), "swept")
    for level in range(levels):
        rows = placed.withColumns({"b_": F.shiftright("p_", level + 1), "up_": F.shiftright("p_", level) % 2 == 1})
        above = Window.partitionBy("b_").orderBy(F.col("s_").desc()).rowsBetween(Window.unboundedPreceding, -1)
        tops = rows.groupBy("b_", "s_").agg(F.max(F.when(F.col("up_"), F.col("z_"))).alias("t_"))
        tops = tops.select("b_", "s_", F.max("t_").over(above).alias("t_"))
        inside = Window.partitionBy("b_", "s_").orderBy(F.col("a_").desc(), F.col("up_").desc()).rowsBetween(Window.unboundedPreceding, 0)
        near = F.max(F.when(F.col("up_"), F.col("z_"))).over(inside)
        met = rows.withColumn("n_", near).join(tops, ["b_", "s_"])
        beaten = ~F.col("up_") & (F.coalesce(F.greatest("n_", "t_") >= F.col("z_"), F.lit(False)))
        placed = stored(met.where(~beaten).select(*placed.columns), "merged")
    return placed.select(*names)


def _front_by_pairs(left: DataFrame, names: list[str], kind: str) -> DataFrame:
    """The front of distinct points of many columns: every pair of ranges of the first one is a task."""
    levels = min(8, max(0, (left.count() // RANGE).bit_length()))
    if levels:
        bounds = left.agg(bounds_of(F.col(names[0]), levels).alias("q_"))
        placed = count_below(left.crossJoin(F.broadcast(bounds)), names[0], "q_", levels, "p_").drop("q_")
    else:
        placed = left.withColumn("p_", F.lit(0))
    last = (1 << levels) - 1
    asks = placed.withColumns({"ask_": F.lit(True), "q_": F.explode(F.sequence(F.col("p_"), F.lit(last)))})
    held = placed.withColumns({"ask_": F.lit(False), "q_": F.col("p_")}).withColumn("p_", F.explode(F.sequence(F.lit(0), F.col("q_"))))

    def beaten(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[names].to_numpy(np.float64)
        ask = pdf["ask_"].to_numpy(bool)
        return pd.DataFrame(x[ask][_dominated(x[ask], x[~ask])], columns=names)

    gone = asks.unionByName(held).groupBy("p_", "q_").applyInPandas(beaten, kind).distinct()
    return left.join(gone, names, "left_anti")


def pareto_front(df: DataFrame, columns: list[str], maximize: list[bool] | None = None) -> DataFrame:
    """Rows that no other row beats in one column without losing in another.

    Rows of equal values are one point. ``CHAMPIONS`` points of the greatest standardised sums go to all tasks and
    drop most others. The points left are dealt into ranges of the first column. Up to three columns: each range is
    swept by itself, then ranges are merged two by two, where points meet the running maxima of the greater half along the
    second column (:func:`merged_front`): n log n comparisons even where all points are on the front. More columns: only a
    range of that or greater values can dominate a point, so every pair of ranges is a task of its own. Rows with a
    null or NaN in a column are left out.
    """
    signs = [1.0 if m else -1.0 for m in (maximize or [True] * len(columns))]
    clean = df.na.drop(subset=columns)
    names = [f"v{i}_" for i in range(len(columns))]
    signed = [(F.col(c).cast("double") * s).alias(n) for c, s, n in zip(columns, signs, names, strict=True)]
    points = clean.select(*signed).distinct()
    kind = ", ".join(f"{n} double" for n in names)
    stats = points.agg(*[f(n) for n in names for f in (F.avg, F.stddev_pop)]).first()
    total = reduce(lambda a, b: a + b, [(F.col(n) - (stats[2 * i] or 0.0)) / (stats[2 * i + 1] or 1.0) for i, n in enumerate(names)])
    best = np.array([list(r) for r in points.orderBy(total.desc(), *names).limit(CHAMPIONS).collect()], np.float64).reshape(-1, len(names))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b.to_numpy(np.float64)
            yield pd.DataFrame(x[~_dominated(x, best)], columns=names)

    left = stored(points.mapInPandas(own, kind), "front")
    front = merged_front(left, names) if len(names) <= 3 else _front_by_pairs(left, names, kind)
    keyed = clean.withColumns(dict(zip(names, [(F.col(c).cast("double") * s) for c, s in zip(columns, signs, strict=True)], strict=True)))
    return keyed.join(front, names, "left_semi").select(*df.columns)


def locate_in_front(point: DataFrame, front: DataFrame, columns: list[str]) -> DataFrame:
    """Of one point: distance to the front's nearest row, share of the front below it by axis and on the mean, and a region."""
    p = point.select(*[F.col(c).alias(f"p_{c}") for c in columns])
    d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"p_{c}")) ** 2 for c in columns])
    mean = lambda pre: reduce(lambda a, b: a + b, [F.col(f"{pre}{c}") for c in columns]) / len(columns)
    rows = front.crossJoin(F.broadcast(p))
    out = rows.agg(F.sqrt(F.min(d2)).alias("distance"), *[(F.avg((F.col(c) < F.col(f"p_{c}")).cast("double")) * 100).alias(f"below_{c}") for c in columns], (F.avg((mean("") < mean("p_")).cast("double")) * 100).alias("below_mean"))
    return out.withColumn("region", F.when(F.col("below_mean") >= 75, "top").when(F.col("below_mean") >= 25, "middle").otherwise("bottom"))


def rank_candidates(df: DataFrame, columns: list[str], key: str, threshold: float = 70.0) -> DataFrame:
    """Average-tie percentiles (100 for the best) of every axis, a min-max composite, and whether all axes reach a threshold."""
    out = df
    for c in columns:
        values = df.groupBy(c).agg(F.count("*").alias("k_"))
        ranked = ranked_prefix(values, c, c, ["k_"], descending=False)
        n = values.agg(F.sum("k_").alias("n_"))
        out = out.join(ranked.crossJoin(F.broadcast(n)).select(c, ((F.col("cum_k_") - (F.col("k_") - 1) / 2) / F.col("n_") * 100).alias(f"pct_{c}")), c)
    ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    out = out.crossJoin(F.broadcast(ends))
    scaled = [F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))) for c in columns]
    all_ = reduce(lambda a, b: a & b, [F.col(f"pct_{c}") >= threshold for c in columns])
    return out.withColumns({"composite": reduce(lambda a, b: a + b, scaled) / len(columns), "all_high": all_}).select(key, *[f"pct_{c}" for c in columns], "composite", "all_high")


def plane_fit(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Least squares z = a x + b y + c from centred sums, with the mean and greatest error."""
    s = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    s = s.withColumns({"a": (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, "b": (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det})
    s = s.withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).select("a", "b", "c")
    err = F.abs(F.col(z) - (F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("c")))
    return df.crossJoin(F.broadcast(s)).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("c").alias("c"), F.avg(err).alias("mean_error"), F.max(err).alias("max_error"))


def intensity_factor(intensity: DataFrame, scenario: str, last: int = 2050, include_end: bool = True, first: int = 2020, base: float = 352.0) -> DataFrame:
    """By scenario the sum over years of the grid's intensity, scaled so that the first year has ``base``.

    Knots are ten years apart and intensities linear between them; ``include_end`` counts the last year, once.
    """
    from .series import interp_series

    years = list(range(first, last + (1 if include_end else 0)))
    yearly = interp_series(intensity.select(scenario, "year", "g_per_kwh"), [scenario], "year", "g_per_kwh", years)
    start = yearly.where(F.col("year") == first).select(scenario, F.col("g_per_kwh").alias("g0_"))
    return yearly.join(start, scenario).groupBy(scenario).agg(F.sum(F.col("g_per_kwh") / F.col("g0_") * base).alias("grams"))


def carbon_matrix(pixels: DataFrame, factors: DataFrame, availability: list[int], efficiency: list[float], kwh: str, area: str = "area_m2", base_efficiency: float = 0.17) -> DataFrame:
    """By scenario, availability (percent) and efficiency: total Gt, mean and median density of avoided carbon.

    A cell's carbon is its yearly energy times the scenario's factor, scaled by availability and efficiency. The
    scaling is common to all cells, so cells are aggregated once and the small tables crossed afterwards.
    """
    density = F.col(kwh) / (F.col(area) / 1e4)
    base = pixels.agg((F.sum(kwh) / 1e15).alias("g_"), (F.avg(density) / 1e6).alias("m_"))
    base = base.crossJoin(quantiles(pixels, {"q_": density}, [0.5]).select((F.col("q_")[0] / 1e6).alias("d_")))
    spark = pixels.sparkSession
    grid = spark.createDataFrame([(a, e, a / 100 * e / base_efficiency) for a in availability for e in efficiency], "availability int, efficiency double, f_ double")
    rows = factors.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(grid))
    k = F.col("grams") * F.col("f_") * 0.27
    return rows.select("scenario", "availability", "efficiency", (F.col("g_") * k).alias("gt"), (F.col("m_") * k).alias("mean_t_ha"), (F.col("d_") * k).alias("median_t_ha"))


def scenario_mean_density(pixels: DataFrame, factors: DataFrame, kwh: str, area: str = "area_m2") -> DataFrame:
    """Pooled mean over cells of the mean over scenarios, its standard error, and the spread between scenarios."""
    f = factors.agg(F.avg("grams").alias("mf_"), (F.stddev("grams") / F.sqrt(F.count("grams"))).alias("ef_"))
    density = F.col(kwh) / (F.col(area) / 1e4) / 1e6 * 0.27
    d = pixels.agg(F.avg(density).alias("md_"), (F.stddev(density) / F.sqrt(F.count(density))).alias("ed_"))
    out = d.crossJoin(F.broadcast(f))
    mean = F.col("md_") * F.col("mf_")
    return out.select(mean.alias("mean"), (F.col("ed_") * F.col("mf_")).alias("sem"), F.sqrt((F.col("ed_") * F.col("mf_")) ** 2 + (F.col("md_") * F.col("ef_")) ** 2).alias("se_all"))


def decade_carbon(pixels: DataFrame, grams: list[float], kwh: str, area: str, key: str) -> DataFrame:
    """Carbon per hectare of a cell by decade, from three sums of intensities, and in all."""
    density = F.col(kwh) / (F.col(area) / 1e4) / 1e6 * 0.27
    out = pixels.select(key, *[(density * g).alias(f"decade_{i + 1}") for i, g in enumerate(grams)])
    return out.withColumn("total", F.col("decade_1") + F.col("decade_2") + F.col("decade_3"))


def crop_revenue_cells(yields: DataFrame, prices: DataFrame, keys: list[str], margin: float = 0.20, rate: float = 1.05, years: int = 30) -> DataFrame:
    """By keys (the cell, and a price's scenario and year): tonnes, revenue, revenue-weighted revenue and its discounted margin.

    A cell's crops travel as one row; scenarios and years are met after that shuffle, inside the row.
    """
    annuity = sum(margin / rate**t for t in range(1, years + 1))
    cell = [k for k in keys if k in yields.columns]
    cells = yields.where("kg > 0").groupBy(*cell).agg(F.collect_list(F.struct("crop", "kg")).alias("y_"))
    series = prices_by_crop(prices, [k for k in keys if k not in cell])
    rows = cells.crossJoin(F.broadcast(series)).select(*keys, crop_revenues(F.col("y_"), F.col("p_")).alias("r_")).where("size(r_) > 0")
    r = F.filter(F.transform("r_", lambda x: x["r"]), lambda x: x.isNotNull())
    revenue = F.when(F.size(r) > 0, total_of(r))
    out = rows.select(*keys, (total_of(F.transform("r_", lambda x: x["kg"])) / 1000).alias("tonnes"), revenue.alias("revenue"), (total_of(F.transform(r, lambda x: x * x)) / revenue).alias("weighted"))
    return out.withColumn("npv", F.col("weighted") * annuity)
