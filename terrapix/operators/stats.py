"""Statistical table jobs: preparation, mixtures, calibration, sampling, evaluation, regressions and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip
from ..functions.distributions import f_upper, probit, t_p_value, t_two_sided
from ..sources.tables import stored
from .quantiles import quantiles
from .ranking import first_rows, first_stored, pit, ranked_prefix
from .spatial import nearest

START = 4096
"""Rows from which the starts of a mixture are drawn."""
RIDGE = 1e-6
STIFF = 1e9
"""Greatest product of a precision and a squared distance from the centre at which log densities come from products: they
keep an error of about 1e-6."""

# Bounds of the difficulty levels and their shares by strategy.
PIT_BINS = {3: (0.0, 0.05, 0.25, 0.60), 2: (0.0, 0.05, 0.30)}
SHARES = {
    3: {"simple": (1.0, 0.0, 0.0), "mixed": (0.6, 0.3, 0.1), "hard": (0.5, 0.4, 0.1)},
    2: {"simple": (0.8, 0.2), "mixed": (0.6, 0.4), "hard": (0.4, 0.6)},
}
# The orthogonal array L18 for six factors of three levels, one row per run.
L18 = (
    (1, 1, 1, 1, 1, 1), (1, 2, 2, 2, 2, 2), (1, 3, 3, 3, 3, 3), (2, 1, 1, 2, 2, 3), (2, 2, 2, 3, 3, 1), (2, 3, 3, 1, 1, 2),
    (3, 1, 2, 1, 3, 2), (3, 2, 3, 2, 1, 3), (3, 3, 1, 3, 2, 1), (1, 1, 3, 3, 2, 2), (1, 2, 1, 1, 3, 3), (1, 3, 2, 2, 1, 1),
    (2, 1, 2, 3, 1, 3), (2, 2, 3, 1, 2, 1), (2, 3, 1, 2, 3, 2), (3, 1, 3, 2, 3, 1), (3, 2, 1, 3, 1, 2), (3, 3, 2, 1, 2, 3),
)


def preprocess(df: DataFrame, numerics: list[str], category: str, classes: range = range(1, 10)) -> DataFrame:
    """Median-imputed, standardised (population) numerics and a fixed one-hot of a class; unknown classes are all zero.

    Medians and moments, a row each, are found once and stored, so that no use of the result finds them again.
    """
    med = stored(quantiles(df, {f"m_{c}": F.col(c) for c in numerics}, [0.5]), "medians")
    filled = df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")[0]) for c in numerics}).drop(*[f"m_{c}" for c in numerics])
    stats = stored(filled.agg(*[f(c).alias(f"{k}_{c}") for c in numerics for k, f in (("mu", F.avg), ("sd", F.stddev_pop))]), "moments")
    scaled = {c: F.when(F.col(f"sd_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")) for c in numerics}
    out = filled.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"{k}_{c}" for c in numerics for k in ("mu", "sd")])
    return out.withColumns({f"{category}_{k}": F.coalesce((F.col(category) == k).cast("int"), F.lit(0)) for k in classes})


def with_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


class Mixture:
    """Weights, means and full covariances of a Gaussian mixture."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, diagonal: bool) -> None:
        self.weights, self.means, self.covs, self.diagonal = weights, means, covs, diagonal
        low = np.linalg.cholesky(covs)
        self.inverse, self.log_scale = np.linalg.inv(low), np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows by components."""
        z = np.einsum("kij,nkj->nki", self.inverse, x[:, None, :] - self.means[None])
        return np.log(self.weights) - 0.5 * (z * z).sum(2) - self.log_scale - 0.5 * x.shape[1] * np.log(2 * np.pi)

    def forms(self) -> tuple[np.ndarray, float]:
        """Coefficients of :meth:`parts` by component on 1, x and the products of x, and the greatest precision."""
        k, d = self.means.shape
        precision = self.inverse.transpose(0, 2, 1) @ self.inverse
        slope = np.einsum("kij,kj->ki", precision, self.means)
        level = np.log(self.weights) - self.log_scale - 0.5 * d * np.log(2 * np.pi) - 0.5 * (slope * self.means).sum(1)
        return np.concatenate([level[:, None], slope, -0.5 * precision.reshape(k, -1)], 1), float(np.linalg.norm(precision, 2, (1, 2)).max())

    def moved(self, by: np.ndarray) -> Mixture:
        return Mixture(self.weights, self.means + by, self.covs, self.diagonal)

    def parameters(self) -> float:
        k, d = self.means.shape
        return k * (1 + d + (d if self.diagonal else d * (d + 1) / 2)) - 1

    def renewed(self, sums: np.ndarray) -> Mixture:
        """The maximisation step from sums of responsibilities, of values and of products, by component."""
        k, d = self.means.shape
        n, s, ss = sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(k, d, d)
        alive = n > 1e-8
        safe = np.where(alive, n, 1.0)
        means = np.where(alive[:, None], s / safe[:, None], self.means)
        covs = ss / safe[:, None, None] - means[:, :, None] * means[:, None, :]
        covs = covs * np.eye(d) if self.diagonal else (covs + covs.transpose(0, 2, 1)) / 2
        covs = np.where(alive[:, None, None], covs, self.covs) + RIDGE * np.eye(d)
        weights = np.maximum(n, 1e-8)
        return Mixture(weights / weights.sum(), means, covs, self.diagonal)


def fit_mixture(
    df: DataFrame,
    columns: list[str],
    ks: list[int],
    key: str,
    seed: int = 42,
    restarts: int = 2,
    diagonal: bool = False,
    criterion: str = "bic",
    rounds: int = 25,
    tolerance: float = 1e-3,
) -> tuple[Mixture, list[tuple]]:
    """The best mixture over numbers of components and ``restarts``, and a list of (k, restart, log-likelihood, BIC, held-out mean).

    All candidates are fitted together: one job a round gives the sums of every candidate, added up by component in
    Spark, so that the driver sees candidates x components x (1 + d + d * d) numbers, whatever the rows. Starts are rows
    of a sample of ``START`` rows by a seeded hash. With ``criterion`` ``bic`` all rows are fitted and the least BIC is
    best; with ``heldout`` every tenth row by a hash of ``key`` is left out and the greatest mean log-likelihood there is
    best. A candidate rests once its mean log-likelihood gains less than ``tolerance``. Rows with a null are left out.

    The log densities of all components are one matrix product of the values and their products, both less the starts'
    mean; a candidate whose components are too narrow for that (``STIFF``) is taken by differences from its means.
    """
    hold = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10)) == 0
    data = df.na.drop(subset=columns).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.xxhash64(F.lit(seed + 1), key).alias("h"), (hold if criterion == "heldout" else F.lit(False)).alias("held"))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, 1)  # every round's work is spread evenly, however the input is cut
    data, d = stored(data.repartition(parts, "h"), "mixture"), len(columns)
    names = [f"x{i}" for i in range(d)]
    start = np.array([list(r)[:d] for r in data.where("not held").orderBy("h", *names).limit(START).select(*names).collect()], np.float64).reshape(-1, d)
    if not len(start):
        raise ValueError("no rows to fit")
    centre = start.mean(0)
    start = start - centre  # models stand in centred values until the end
    spread = np.cov(start, rowvar=False, ddof=0).reshape(d, d) if len(start) > 1 else np.eye(d)
    spread = (spread * np.eye(d) if diagonal else spread) + RIDGE * np.eye(d)
    models, resting = {}, set()
    for k in ks:
        for r in range(restarts):
            rng = np.random.default_rng([seed, k, r])
            models[k, r] = Mixture(np.full(k, 1 / k), start[rng.choice(len(start), k, replace=len(start) < k)], np.repeat(spread[None], k, 0), diagonal)
    order = list(models)

    def sums_of(current: dict) -> dict:
        """Of each candidate: (sums by component, log-likelihood, rows, held-out log-likelihood, held-out rows)."""

        forms, at, to = {c: m.forms() for c, m in current.items()}, {}, 0
        for c, m in current.items():
            at[c], to = slice(to, to + len(m.weights)), to + len(m.weights)
        form = np.concatenate([f for f, _ in forms.values()])

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(form.shape)
            ends = {c: np.zeros(4) for c in current}
            for b in batches:
                values, away = b[names].to_numpy(np.float64) - centre, b["held"].to_numpy(bool)
                for lo in range(0, len(values), 512):
                    x, held = values[lo : lo + 512], away[lo : lo + 512]
                    both = np.concatenate([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)], 1)
                    share, reach = form @ both.T, (x * x).sum(1).max()  # components by rows
                    for c, m in current.items():
                        own = share[at[c]]
                        if forms[c][1] * reach > STIFF:
                            own[:] = m.parts(x).T
                        top = own.max(0)
                        own -= top
                        np.exp(own, out=own)
                        dens = own.sum(0)
                        own /= dens
                        dens = top + np.log(dens)
                        ends[c] += [dens[~held].sum(), (~held).sum(), dens[held].sum(), held.sum()]
                    total += share @ (both * ~held[:, None])
            for c in current:
                values = np.concatenate([total[at[c]].ravel(), ends[c]])
                yield pd.DataFrame({"c": order.index(c), "i": np.arange(len(values)), "v": values})

        got = data.select(*names, "held").mapInPandas(work, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).toPandas()
        out = {}
        for c, part in got.groupby("c"):
            v = part.sort_values("i")["v"].to_numpy()
            out[order[c]] = (v[:-4].reshape(-1, 1 + d + d * d), *v[-4:].tolist())
        return out

    last: dict = {}
    for step in range(rounds + 1):
        active = {c: m for c, m in models.items() if c not in resting}
        if not active:
            break
        for c, (sums, ll, n, held_ll, held_n) in sums_of(active).items():
            if step == rounds or (c in last and (ll - last[c][0]) / max(1.0, n) < tolerance):
                resting.add(c)
            else:
                models[c] = models[c].renewed(sums)
            last[c] = (ll, n, held_ll, held_n)
    table = []
    for c, m in models.items():
        ll, n, held_ll, held_n = last[c]
        table.append((*c, ll, math.log(max(1.0, n)) * m.parameters() - 2 * ll, held_ll / held_n if held_n else float("nan")))
    best = min(table, key=lambda t: t[3]) if criterion == "bic" else max(table, key=lambda t: t[4])
    return models[best[:2]].moved(centre), table


def mixture_arrays(model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return model.weights, model.means, model.covs


def _log_parts(x: np.ndarray, weights: np.ndarray, means: np.ndarray, chol: list[np.ndarray]) -> np.ndarray:
    """Log of weight times density, rows by components."""
    parts = np.empty((len(x), len(weights)))
    for k, low in enumerate(chol):
        z = np.linalg.solve(low, (x - means[k]).T)
        parts[:, k] = np.log(weights[k]) - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return parts


def _log_total(parts: np.ndarray) -> np.ndarray:
    if not len(parts):
        return np.empty(0)
    top = parts.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(parts - top).sum(1))


def mixture_score(df: DataFrame, columns: list[str], weights: np.ndarray, means: np.ndarray, covs: np.ndarray, key: str) -> DataFrame:
    """(key, logdens, posterior, component) of every row, by log-sum-exp; the model is small and goes with the task."""
    chol = [np.linalg.cholesky(c) for c in covs]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = _log_parts(b[columns].to_numpy(np.float64), weights, means, chol)
            total = _log_total(parts)
            post = np.exp(parts - total[:, None])
            yield pd.DataFrame({key: b[key], "logdens": total, "posterior": list(post), "component": post.argmax(1) if len(parts) else []})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns).mapInPandas(work, f"`{key}` {kind}, logdens double, posterior array<double>, component int")


def log_density(df: DataFrame, columns: list[str], weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> DataFrame:
    """(logdens) of every row, as :func:`mixture_score` has it."""
    chol = [np.linalg.cholesky(c) for c in covs]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"logdens": _log_total(_log_parts(b[columns].to_numpy(np.float64), weights, means, chol))})

    return df.select(*columns).mapInPandas(work, "logdens double")


def calibrate(df: DataFrame, column: str, robust: bool = True) -> DataFrame:
    """One row of mu, sd, low and high: median and 1.4826 times the MAD, or mean and deviation."""
    if not robust:
        return df.agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sd"), F.min(column).alias("low"), F.max(column).alias("high"))
    med = quantiles(df, {"mu": F.col(column)}, [0.5]).select(F.col("mu")[0].alias("mu"))
    mad = quantiles(df.crossJoin(F.broadcast(med)), {"d_": F.abs(F.col(column) - F.col("mu"))}, [0.5])
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return med.crossJoin(mad).crossJoin(ends).select("mu", (F.col("d_")[0] * 1.4826 + 1e-12).alias("sd"), "low", "high")


def env_score(df: DataFrame, column: str, stats: DataFrame, method: str = "sigmoid", alpha: float = 1.0, out: str = "score") -> DataFrame:
    """Score of a log density by fixed statistics: sigmoid (exponent cut to 50), minmax (cut to 0..1) or zscore."""
    x = F.col(column)
    score = {
        "sigmoid": 1 / (1 + F.exp(-clip(alpha * (x - F.col("mu")), -50.0, 50.0))),
        "minmax": clip((x - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)), 0.0, 1.0),
        "zscore": (x - F.col("mu")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0),
    }[method]
    return df.crossJoin(F.broadcast(stats)).withColumn(out, score).drop("mu", "sd", "low", "high")


def similar_mask(reference: DataFrame, query: DataFrame, column: str, q: float = 0.05) -> DataFrame:
    """Whether a row's log density reaches the reference's quantile, and its z-score there."""
    ref = quantiles(reference, {"q_": F.col(column)}, [q]).select(F.col("q_")[0].alias("cut_"))
    ref = ref.crossJoin(reference.agg(F.avg(column).alias("mu_"), F.stddev_pop(column).alias("sd_")))
    out = query.crossJoin(F.broadcast(ref))
    return out.withColumns({"similar": F.col(column) >= F.col("cut_"), "z": (F.col(column) - F.col("mu_")) / F.col("sd_")}).drop("cut_", "mu_", "sd_")


def cluster_posterior(df: DataFrame, key: str, posterior: str, clusters: dict[int, int]) -> DataFrame:
    """(key, cluster probabilities p0.., dominant, entropy, and entropy over its greatest) from component posteriors."""
    names = sorted(set(clusters.values()))
    sums = {c: reduce(lambda a, b: a + b, [F.get(posterior, F.lit(k)) for k, v in clusters.items() if v == c]) for c in names}
    out = df.select(key, *[sums[c].alias(f"p{c}") for c in names])
    top = F.greatest(*[f"p{c}" for c in names])
    dominant = reduce(lambda o, c: F.when(F.col(f"p{c}") == top, c).otherwise(o), reversed(names), F.lit(None).cast("int"))
    term = lambda c: -F.greatest(F.col(f"p{c}"), F.lit(1e-10)) * F.log(F.greatest(F.col(f"p{c}"), F.lit(1e-10)))
    out = out.withColumns({"dominant": dominant, "entropy": reduce(lambda a, b: a + b, [term(c) for c in names])})
    return out.withColumn("entropy_share", F.col("entropy") / math.log(max(2, len(names))))


def pattern_score(weights: np.ndarray, means: np.ndarray, covs: np.ndarray, groups: dict[str, list[int]]) -> list[tuple]:
    """(component, group, score): sum over a group's features of |mean| * sqrt(variance), times the component's weight."""
    return [(k, g, float(sum(abs(means[k, i]) * math.sqrt(covs[k, i, i]) for i in idx) * weights[k])) for k in range(len(weights)) for g, idx in groups.items()]


def hex_pattern(posterior: DataFrame, scores: DataFrame, cell: list[str]) -> DataFrame:
    """Pattern scores of components weighted by the mean posterior in a cell."""
    rows = posterior.select(*cell, F.posexplode("posterior").alias("component", "p")).groupBy(*cell, "component").agg(F.avg("p").alias("p"))
    return rows.join(scores, "component").groupBy(*cell, "pattern").agg(F.sum(F.col("p") * F.col("score")).alias("score"))


def classify_pattern(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Dominant, Mixed-Quad, Mixed-Triple, Mixed-Dual or Undefined, from the shares of four scores in order."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    pairs = F.array(*[F.struct((-F.col(c) / total).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    out = df.withColumn("o_", F.when(total >= 1e-10, F.array_sort(pairs)))
    r = [-F.col("o_")[i]["s"] for i in range(4)]
    kind = (
        F.when(F.col("o_").isNull(), "Undefined")
        .when(r[0] > 0.55, "Dominant")
        .when((r[3] > 0.12) & (r[0] < 0.40), "Mixed-Quad")
        .when((r[2] > 0.15) & (r[0] < 0.50), "Mixed-Triple")
        .when((r[1] > 0.20) & (r[0] < 0.55), "Mixed-Dual")
        .otherwise("Dominant")
    )
    return out.select(key, kind.alias("pattern"), F.col("o_")[0]["name"].alias("first"))


def negatives_by_selection(positives: DataFrame, pool: DataFrame, column: str, key: str, ratio: float = 1.0, strategy: str = "mixed", levels: int = 3, seed: int = 42) -> DataFrame:
    """Pool rows chosen as negatives: by bins of their share of positives that are not above them, so many of each bin.

    Rows of a bin are the first ones in the order of a seeded hash; no task sorts a whole bin.
    """
    bins, shares = PIT_BINS[levels], SHARES[levels][strategy]
    need = max(1, round(positives.count() * ratio))
    quota = [round(need * s) for s in shares]
    scored = pit(positives, pool, column)
    level = reduce(lambda o, i: F.when((F.col("pit") >= bins[i]) & (F.col("pit") < bins[i + 1]), i).otherwise(o), range(levels), F.lit(None).cast("int"))
    rows = scored.withColumn("level", level).where("level is not null").withColumn("h_", F.xxhash64(F.lit(seed), key).cast("double"))
    rows = stored(rows, "levels")
    chosen = [first_stored(rows.where(F.col("level") == i), q, "h_", key) for i, q in enumerate(quota)]
    return reduce(DataFrame.unionByName, chosen).select(*pool.columns, "pit", "level")


def labelled_union(positives: DataFrame, negatives: DataFrame, columns: list[str]) -> DataFrame:
    """Both with ``label`` 1 and 0."""
    return positives.select(*columns, F.lit(1).alias("label")).unionByName(negatives.select(*columns, F.lit(0).alias("label")))


def negatives_by_generation(positives: DataFrame, key: str, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, columns: list[str], n: int, cut: float, jitter: float = 0.15, seed: int = 7) -> DataFrame:
    """``n`` rows (id, columns, nearest): positives nearest to draws from a mixture whose log density is below ``cut``.

    Each draw takes the values of the positive nearest to it among the ``columns`` (two or three, ties by key), which
    is named in ``nearest``, with normal noise of ``jitter`` times the positives' deviations. Further ranges of draws
    follow, sized by the share that passed, until ``n`` pass. Raises if 8 ranges do not give them.
    """
    spark = positives.sparkSession
    chol = np.array([np.linalg.cholesky(c) for c in covs])
    edges = np.cumsum(weights) / weights.sum()
    d = means.shape[1]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = np.minimum(np.searchsorted(edges, b["u"].to_numpy()), len(edges) - 1)
            x = means[k] + np.einsum("nij,nj->ni", chol[k], b[[f"z{i}" for i in range(d)]].to_numpy(np.float64))
            low = _log_total(_log_parts(x, weights, means, list(chol))) < cut
            yield pd.DataFrame({"id": b["id"][low], **{c: x[low, i] for i, c in enumerate(columns)}})

    def passed(start: int, stop: int, seed: int) -> DataFrame:
        base = spark.range(start, stop).select("id", F.rand(seed).alias("u"), *[F.randn(seed + 1 + i).alias(f"z{i}") for i in range(d)])
        return stored(base.mapInPandas(draw, "id long, " + ", ".join(f"`{c}` double" for c in columns)), "drawn")

    parts, have, start, stop = [], 0, 0, max(1, n * 4)
    for k in range(8):
        last = passed(start, stop, seed + 1000 * k)
        before, have = have, have + last.count()
        if have >= n:
            parts.append(first_stored(last, n - before, "id", "id"))
            break
        parts.append(last)
        more = int((n - have) * stop / have * 1.2) + 16 if have else 4 * stop
        start, stop = stop, stop + more
    else:
        raise RuntimeError(f"only {have} of {n} rows passed in {stop} draws")
    chosen = reduce(DataFrame.unionByName, parts)
    near = nearest(chosen, positives.withColumnRenamed(key, "nearest"), "id", "nearest", columns, axes=tuple(columns))
    noise = positives.agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in columns])
    rows = near.crossJoin(F.broadcast(noise))
    unit = lambda i: F.sqrt(-2 * F.log(draw01(F.col("id"), seed + 10 + i))) * F.cos(2 * math.pi * draw01(F.col("id"), seed + 50 + i))
    return rows.select("id", *[(F.col(c) + jitter * F.col(f"sd_{c}") * unit(i)).alias(c) for i, c in enumerate(columns)], "nearest")


def draw01(key: Column, seed: int) -> Column:
    """A number above 0 and up to 1 that a hash makes of a key, the same every time."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + 1) / float(1 << 53)


def negatives_hybrid(selected: DataFrame, generated: DataFrame, n: int, share: float = 0.7, key: str = "id") -> DataFrame:
    """``share`` of ``n`` rows from the selected ones, the rest from the generated ones."""
    a = round(n * share)
    some = lambda df, m: first_rows(df.withColumn("h_", F.xxhash64(key)), m, "h_", key).drop("h_")
    return some(selected, a).unionByName(some(generated, n - a))


def stratified_split(df: DataFrame, label: str, key: str, parts: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 1) -> DataFrame:
    """``df`` with ``part`` 0, 1, ...: exact shares of every label in the order of a seeded hash."""
    rows = df.withColumn("h_", F.xxhash64(F.lit(seed), key).cast("double"))
    ranked = ranked_prefix(rows, "h_", key, [], descending=False, by=[label])
    edges = np.cumsum(parts)[:-1]
    part = reduce(lambda a, b: a + b, [(F.col("rank") > F.round(F.col("n") * float(e))).cast("int") for e in edges])
    return ranked.withColumn("part", part).select(*df.columns, "part")


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: confusion, accuracy, precision, recall, F1, AUC, log loss, MCC, kappa and balanced accuracy.

    The AUC comes from average ranks of distinct scores, summed along the scores in ranges.
    """
    y, p = F.col(label) == 1, F.col(score)
    hit = p >= threshold
    q = clip(p, 1e-15, 1 - 1e-15)
    one = df.agg(F.count_if(y & hit).cast("double").alias("tp"), F.count_if(~y & hit).cast("double").alias("fp"), F.count_if(y & ~hit).cast("double").alias("fn"), F.count_if(~y & ~hit).cast("double").alias("tn"), (-F.avg(F.when(y, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))
    values = df.groupBy(score).agg(F.count_if(y).alias("pos_"), F.count("*").alias("k_"))
    ranked = ranked_prefix(values, score, score, ["k_"], descending=False)
    ranks = ranked.agg(F.sum(F.col("pos_") * (F.col("cum_k_") - (F.col("k_") - 1) / 2)).alias("r_"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n, np_, nn = tp + fp + fn + tn, tp + fn, fp + tn
    acc = (tp + tn) / n
    chance = ((tp + fp) * np_ + (fn + tn) * nn) / (n * n)
    return one.crossJoin(F.broadcast(ranks)).select(
        "tp", "fp", "fn", "tn", acc.alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, np_).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(F.col("r_") - np_ * (np_ + 1) / 2, np_ * nn).alias("auc"), "log_loss", F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * np_ * nn * (tn + fn))).alias("mcc"),
        F.try_divide(acc - chance, 1 - chance).alias("kappa"), ((F.try_divide(tp, np_) + F.try_divide(tn, nn)) / 2).alias("balanced_accuracy"),
    )


def pu_threshold_sweep(test: DataFrame, unlabelled: DataFrame, label: str, score: str, ratio: float = 0.3, least_detection: float = 0.001) -> DataFrame:
    """Counts and rates at thresholds 0.05 to 0.95, with the detection rate on unlabelled rows and F1 forms from it.

    ``f1_pu`` is recall squared over detection; precision is also corrected to the share of positives in training.
    """
    cuts = [round(0.05 * i, 2) for i in range(1, 20)]
    y, p = F.col(label) == 1, F.col(score)
    one = lambda name, c: [F.count_if(c(t)).alias(f"{name}{i}") for i, t in enumerate(cuts)]
    a = test.agg(*one("tp", lambda t: y & (p >= t)), *one("fn", lambda t: y & (p < t)), *one("fp", lambda t: ~y & (p >= t)), *one("tn", lambda t: ~y & (p < t)))
    b = unlabelled.agg(*[F.avg((p >= t).cast("double")).alias(f"d{i}") for i, t in enumerate(cuts)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{k}{i}").cast("double").alias(k) for k in ("tp", "fn", "fp", "tn")], F.col(f"d{i}").alias("detection")) for i, t in enumerate(cuts)]))
    out = a.crossJoin(b).select(rows.alias("x")).select("x.*")
    r, pr = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    fpr = F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0))
    prior = 1 / (1 + ratio)
    fixed = F.coalesce(F.try_divide(r * prior, r * prior + fpr * (1 - prior)), F.lit(0.0))
    out = out.withColumns({"recall": r, "precision": pr, "fpr": fpr, "precision_corrected": fixed})
    return out.withColumns(
        {
            "f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)),
            "f1_pu": F.col("recall") ** 2 / F.greatest(F.col("detection"), F.lit(least_detection)),
            "reliability": F.when(F.col("detection") < least_detection, "Low").when(F.col("detection") < 10 * least_detection, "Medium").otherwise("High"),
        }
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The reliable row of greatest f1_pu (the least threshold of ties); the one of greatest detection if none is reliable."""
    reliable = F.col("reliability") != "Low"
    return sweep.agg(F.coalesce(F.max_by(F.when(reliable, F.col("threshold")), F.when(reliable, F.struct("f1_pu", -F.col("threshold")))), F.max_by("threshold", F.struct("detection", -F.col("threshold")))).alias("threshold"))


CLASSIFIERS = {
    "forest": lambda d: RandomForestClassifier(numTrees=20, maxDepth=5, seed=1),
    "boosted": lambda d: GBTClassifier(maxIter=10, maxDepth=4, seed=1),
    "logistic": lambda d: LogisticRegression(maxIter=30),
    "mlp": lambda d: MultilayerPerceptronClassifier(layers=[d, 8, 2], maxIter=40, seed=1),
}


def score_model(model, df: DataFrame, columns: list[str], out: str = "p") -> DataFrame:
    return model.transform(with_vector(df, columns)).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train_compare(train: DataFrame, test: DataFrame, columns: list[str], label: str, names: tuple[str, ...] = ("forest", "boosted", "logistic", "mlp")):
    """Fitted models by name and a table of their test metrics, the best F1 first."""
    parts = max(2 * train.sparkSession.sparkContext.defaultParallelism, 1)
    data = stored(train.select(*columns, label).repartition(parts), "train")  # the fits read it many times; spread evenly
    data = with_vector(data, columns).select("features", F.col(label).cast("double").alias("label")).persist()
    test = stored(test.select(*columns, label).repartition(parts), "test")
    models, tables = {}, []
    for name in names:
        models[name] = CLASSIFIERS[name](len(columns)).fit(data)
        scored = stored(score_model(models[name], test, columns).select(label, "p"), "scored")  # the metrics read it in several passes
        tables.append(binary_metrics(scored, label, "p").withColumn("model", F.lit(name)))
    data.unpersist()
    return models, reduce(lambda a, b: a.unionByName(b), tables).orderBy(F.desc("f1"), "model")


def score_pool(train: DataFrame, test: DataFrame, pool: DataFrame, negatives: DataFrame, columns: list[str], label: str, key: str, names: tuple[str, ...] = ("forest", "boosted", "logistic", "mlp")) -> tuple[DataFrame, str]:
    """(key, p) of the pool by the compared model with the best F1 on ``test``, and 0 for the rows sampled as negatives;
    with that model's name. A row that is in both counts as a negative."""
    models, table = train_compare(train, test, columns, label, names)
    best = table.first().model
    rest = pool.join(negatives.select(key).distinct(), key, "left_anti")
    return score_model(models[best], rest, columns).select(key, "p").unionByName(negatives.select(key, F.lit(0.0).alias("p"))), best


def learning_curve(df: DataFrame, columns: list[str], label: str, key: str, sizes: tuple[float, ...] = (0.2, 0.6, 1.0), folds: int = 3) -> DataFrame:
    """Train and validation accuracy by share of the training rows, over hash folds, for a logistic model."""
    rows = with_vector(df, columns).select(key, "features", F.col(label).cast("double").alias("label")).withColumns({"fold_": F.pmod(F.xxhash64(F.lit(3), key), F.lit(folds)), "u_": F.pmod(F.xxhash64(F.lit(4), key), F.lit(1000)) / 1000}).persist()
    parts = []
    for size in sizes:
        for k in range(folds):
            own = rows.where((F.col("fold_") != k) & (F.col("u_") < size))
            model = LogisticRegression(maxIter=20).fit(own)
            right = lambda x, m=model: m.transform(x).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
            parts.append((size, k, right(own), right(rows.where(F.col("fold_") == k))))
    frames = [a.select(F.lit(s).alias("size"), F.lit(k).alias("fold"), F.col("a").alias("train")).crossJoin(b.select(F.col("a").alias("valid"))) for s, k, a, b in parts]
    out = reduce(lambda a, b: a.union(b), frames)
    return out.groupBy("size").agg(F.avg("train").alias("train"), F.avg("valid").alias("valid"), F.avg(F.col("train") - F.col("valid")).alias("gap"))


def ols_univariate(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Slope, intercept, R2 and number of rows of y on each x, in one pass."""
    row = lambda x: F.struct(F.lit(x).alias("x"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    one = df.agg(*[row(x).alias(f"s{i}") for i, x in enumerate(xs)])
    return one.select(F.explode(F.array(*[f"s{i}" for i in range(len(xs))])).alias("r")).select("r.*")


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Coefficients with errors, t and p values and inflation factors; R2, adjusted R2, F test, AIC, BIC and the
    condition number of the design (with its intercept) repeated."""
    data = with_vector(df.na.drop(subset=[y, *xs]), xs)
    model = LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(data)
    s = model.summary
    n, k = s.numInstances, len(xs)
    corr = np.zeros((k, k))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = df.na.drop(subset=[y, *xs]).agg(*[F.corr(xs[i], xs[j]) for i, j in pairs]).first()
    for (i, j), v in zip(pairs, got, strict=True):
        corr[i, j] = corr[j, i] = 1.0 if i == j else v
    vif = np.diag(np.linalg.pinv(corr))
    design = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    gram = np.zeros((k + 1, k + 1))
    for (i, j), v in zip(cells, df.na.drop(subset=[y, *xs]).agg(*[F.sum(design[i] * design[j]) for i, j in cells]).first(), strict=True):
        gram[i, j] = gram[j, i] = v
    w = np.linalg.eigvalsh(gram)
    condition = math.sqrt(w.max() / max(w.min(), 1e-300))
    rss = s.meanSquaredError * n
    ll = -n / 2 * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1)
    f = (s.r2 / k) / max(1e-300, (1 - s.r2) / (n - k - 1))
    fit = (float(s.r2), float(1 - (1 - s.r2) * (n - 1) / (n - k - 1)), float(f_upper(f, k, n - k - 1)), 2 * (k + 1) - 2 * ll, math.log(n) * (k + 1) - 2 * ll, condition)
    coefs = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    rows = [(name, c, float(e), float(t), float(t_two_sided(t, n - k - 1)), float(v), *fit) for name, c, e, t, v in zip([*xs, "intercept"], coefs, s.coefficientStandardErrors, s.tValues, [*vif.tolist(), float("nan")], strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, error double, t double, p double, vif double, r2 double, r2_adjusted double, p_model double, aic double, bic double, condition double")


def transform_vars(df: DataFrame, column: str) -> DataFrame:
    """Standardised, log-shifted, root-shifted and squared forms of a column, and the logit and probit of its squeezed min-max form."""
    s = df.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"), F.avg(column).alias("mu_"), F.stddev_pop(column).alias("sd_"), F.count(column).alias("n_"))
    x = F.col(column)
    unit = (x - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))
    squeezed = (unit * (F.col("n_") - 1) + 0.5) / F.col("n_")
    out = df.crossJoin(F.broadcast(s)).withColumns({"standard": (x - F.col("mu_")) / F.col("sd_"), "log_shift": F.log(x - F.col("lo_") + 1), "sqrt_shift": F.sqrt(x - F.col("lo_") + 0.001), "square": x * x, "logit": F.log(squeezed / (1 - squeezed)), "probit": probit(squeezed)})
    return out.drop("lo_", "hi_", "mu_", "sd_", "n_")


def box_cox_lambda(df: DataFrame, column: str, grid: tuple[float, ...] = (-2, -1.5, -1, -0.5, 0, 0.5, 1, 1.5, 2)) -> DataFrame:
    """(lambda, log-likelihood) on positive values, one aggregate for the whole grid."""
    x = F.col(column)
    form = lambda g: F.log(x) if g == 0 else (F.pow(x, F.lit(float(g))) - 1) / g
    one = df.where(x > 0).agg(F.count("*").alias("n"), F.sum(F.log(x)).alias("sl"), *[F.var_pop(form(g)).alias(f"v{i}") for i, g in enumerate(grid)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("lam"), (-F.col("n") / 2 * F.log(f"v{i}") + (g - 1) * F.col("sl")).alias("ll")) for i, g in enumerate(grid)]))
    return one.select(rows.alias("r")).select("r.*")


def yeo_johnson(x: Column, g: float) -> Column:
    """The Yeo-Johnson transform, for values of either sign."""
    up = F.log1p(F.abs(x)) if g == 0 else (F.pow(F.abs(x) + 1, F.lit(float(g))) - 1) / g
    down = F.log1p(F.abs(x)) if g == 2 else (F.pow(F.abs(x) + 1, F.lit(float(2 - g))) - 1) / (2 - g)
    return F.when(x >= 0, up).otherwise(-down)


def yeo_johnson_lambda(df: DataFrame, column: str, grid: tuple[float, ...] = (-2, -1.5, -1, -0.5, 0, 0.5, 1, 1.5, 2)) -> DataFrame:
    """(lambda, log-likelihood) of the Yeo-Johnson transform, one aggregate for the whole grid."""
    x = F.col(column).cast("double")
    one = df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("sl"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("lam"), (-F.col("n") / 2 * F.log(f"v{i}") + (g - 1) * F.col("sl")).alias("ll")) for i, g in enumerate(grid)]))
    return one.select(rows.alias("r")).select("r.*")


@dataclass
class Power:
    """The exponent of a power transform with the greatest likelihood, that likelihood and the jobs it took."""

    kind: str
    lam: float
    likelihood: float
    jobs: int


def power_form(x: Column, lam: float | Column, kind: str = "yeo_johnson") -> Column:
    """The Box-Cox (of values above 0, else null) or Yeo-Johnson transform with an exponent that may be a column."""
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    part = lambda v, g: F.when(F.abs(g) < 1e-9, F.log(v)).otherwise((F.pow(v, g) - 1) / g)
    if kind == "box_cox":
        return F.when(x > 0, part(x, lam))
    return F.when(x >= 0, part(F.abs(x) + 1, lam)).otherwise(-part(F.abs(x) + 1, 2 - lam))


def best_lambda(df: DataFrame, column: str, kind: str = "yeo_johnson", low: float = -2.0, high: float = 3.0, probes: int = 24, tolerance: float = 1e-5) -> Power | None:
    """The exponent with the greatest likelihood, by brackets: a job evaluates ``probes`` exponents, and the two beside the
    best are the next bracket. At an end of a bracket the next one lies beyond it, three times as wide. Ends with a
    parabola through the last three; 8 jobs at most. None for a column without (positive) values."""
    x = F.col(column).cast("double")
    rows = df.where((x > 0) if kind == "box_cox" else (x.isNotNull() & ~F.isnan(x))).select(x.alias("x_"))
    slope = F.log("x_") if kind == "box_cox" else F.signum("x_") * F.log1p(F.abs(F.col("x_")))
    total = rows.agg(F.count("*").alias("n"), F.sum(slope).alias("s")).first()
    if not total.n:
        return None
    for job in range(2, 9):
        lams = np.linspace(low, high, probes)
        tried = F.posexplode(F.array(*[F.lit(v) for v in lams.tolist()])).alias("at", "lam")
        form = power_form(F.col("x_"), F.col("lam"), kind)
        spreads = {r["at"]: r.v for r in rows.select("x_", tried).groupBy("at").agg(F.var_pop(form).alias("v")).collect()}
        spread = np.array([spreads[i] for i in range(probes)], np.float64)
        found = -total.n / 2 * np.log(np.maximum(spread, 1e-300)) + (lams - 1) * total.s
        k, step = int(found.argmax()), lams[1] - lams[0]
        if step <= tolerance or spread.max() <= 0:
            break
        wide = 3 * (high - low)
        low, high = (lams[0] - wide, lams[1]) if k == 0 else (lams[-2], lams[-1] + wide) if k == probes - 1 else (lams[k - 1], lams[k + 1])
    lam = float(lams[k])
    if 0 < k < probes - 1:
        a, b, c = found[k - 1 : k + 2]
        bend = a - 2 * b + c
        lam += float(step * np.clip(0.5 * (a - c) / bend, -1, 1)) if bend < 0 else 0.0
    return Power(kind, lam, float(found[k]), job)


def transform_recommended(df: DataFrame, column: str, out: str = "transformed") -> tuple[DataFrame, Power | None]:
    """``df`` with the column's best power transform: Box-Cox where all values are above 0, else Yeo-Johnson."""
    least = df.agg(F.min(F.col(column).cast("double")).alias("m")).first().m
    power = best_lambda(df, column, "box_cox" if least is not None and least > 0 else "yeo_johnson")
    x = F.col(column).cast("double")
    return df.withColumn(out, F.lit(None).cast("double") if power is None else power_form(x, power.lam, power.kind)), power


def ttest_table(df: DataFrame, group: str, value: str) -> DataFrame:
    """By group: n, mean, deviation, t against zero, Cohen's d and the normal 95 % interval."""
    out = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.withColumns({"t": F.try_divide(F.col("mean"), se), "d": F.try_divide("mean", "sd"), "low": F.col("mean") - 1.96 * se, "high": F.col("mean") + 1.96 * se})


def with_p_values(table: DataFrame) -> DataFrame:
    """A small table with ``p`` of its t and n - 1, and stars."""
    out = table.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1))
    return out.withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def paired_table(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    return ttest_table(df.withColumn("diff_", F.col(a) - F.col(b)), group, "diff_")


def sample_by_group(df: DataFrame, groups: list[str], n: int, key: str, seed: int = 5) -> DataFrame:
    """``n`` rows of every group by the order of a seeded hash; a group of any size is cut down in parts first."""
    return first_rows(df.withColumn("h_", F.xxhash64(F.lit(seed), key)), n, "h_", key, groups).drop("h_")


def design_l18(spark, levels: dict[str, list]) -> DataFrame:
    """Eighteen runs of six factors with three levels each."""
    names = list(levels)
    rows = [(k + 1, *[float(levels[f][row[i] - 1]) for i, f in enumerate(names)]) for k, row in enumerate(L18)]
    return spark.createDataFrame(rows, "exp_id int, " + ", ".join(f"`{f}` double" for f in names))


def sensitivity_tables(runs: DataFrame, factors: list[str], metric: str) -> DataFrame:
    """Mean of the metric by level of every factor."""
    return runs.unpivot(["exp_id", metric], factors, "factor", "level").groupBy("factor", "level").agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    return runs.agg(F.max_by("exp_id", F.struct(metric, -F.col("exp_id"))).alias("exp_id"))




