"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, rerank by exact cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bit_map
from .components import components
from .scratch import materialise
from .simhash import _merge
from .skew import hot_keys, salted_join

SAMPLE = 16_384
"""Vectors that the rotations are learnt from at most."""
BITS = 64
WITHIN = 7
"""Codes of 32 bits or more that differ in so many bits or fewer always meet in a table, whatever the number of vectors."""
RADIUS = 12
"""Codes that meet and differ in more bits are not looked at further. With ``BITS`` for both all pairs of a label meet."""
HOT = 4096
"""A bucket with more members is searched by several tasks."""
FEW_HOT = 100_000
STEP = 1024
SMALL = 64
SHARE = 16
"""Hot buckets of codes are recognised by every 16th code; that only tells how the work is dealt."""


def unit_rows(vectors: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors are whole, those as unit rows in double precision). Null, zero, non-finite vectors, vectors
    with null components and, where ``dim`` is given, vectors of another length are not."""
    good, rows = np.zeros(len(vectors), bool), []
    for k, v in enumerate(vectors):
        if v is None or not len(v) or (dim is not None and len(v) != dim):
            continue
        x = np.asarray(v, dtype=np.float64)  # a null becomes NaN
        if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
            x = x / top
            good[k] = True
            rows.append(x / np.sqrt(x @ x))
    return good, np.array(rows).reshape(len(rows), dim if dim is not None else (len(rows[0]) if rows else 0))


class Quantiser:
    """Binary codes of unit vectors: centred, on principal axes, turned so that the signs lose least."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 7) -> None:
        self.dim = sample.shape[1]
        bits = min(bits, self.dim)
        self.mean = sample.mean(0) if len(sample) else np.zeros(self.dim)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        flat = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds if len(sample) else 0):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        self.turn = axes @ turn

    def codes(self, rows: np.ndarray) -> np.ndarray:
        bits = ((rows - self.mean) @ self.turn) > 0
        return bits @ (np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64))


class Quantisers(dict):
    """A quantiser for every length of vector; one that the sample did not hold has no rotation to learn."""

    def __missing__(self, dim: int) -> Quantiser:
        self[dim] = Quantiser(np.empty((0, dim)))
        return self[dim]


def fit_quantisers(vectors: DataFrame, id_col: str, vec_col: str, sample: int = SAMPLE) -> Quantisers:
    """Learn the rotations from ``sample`` whole vectors at most, the first by a hash of the id."""
    rows = (
        vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.xxhash64(id_col).alias("h"), F.col(vec_col).alias("v"))
        .orderBy("h", "v")
        .limit(sample)
        .collect()
    )
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r.v), []).append(r.v)
    return Quantisers({d: Quantiser(unit_rows(v, d)[1]) for d, v in by_length.items() if d})


class Tables:
    """Cuts of a code into parts, one table each, and how many bits may differ in a part for two codes to meet there.

    Parts grow with the logarithm of the number of vectors, so that buckets do not. By the pigeonhole principle
    two codes within ``within`` bits meet in a table if the radii and the number of tables add up to more than that.
    A code lies in its own bucket (at home) and, in a table of radius 1, visits those of the keys with one bit less.
    More than that finds (``within`` of twice the number of tables or more) takes one table, in which all codes meet.
    """

    def __init__(self, bits: int, vectors: int, within: int = WITHIN) -> None:
        size = min(16, max(8, max(1, vectors).bit_length() - 4))
        n = min(bits, max(4, min(8, bits // size)))
        cut = [round(k * bits / n) for k in range(n + 1)]
        self.cuts = list(zip(cut, cut[1:], strict=False))
        self.radii = [int(t < within + 1 - n) for t in range(n)]
        if within >= 2 * n and within > WITHIN:
            self.cuts, self.radii = [(0, 0)], [0]

    def entries(self, code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(table, numbers of codes, their keys, whether they are at home)."""
        for t, (a, b) in enumerate(self.cuts):
            key = ((code >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            yield t, np.arange(len(code)), key, True
            for j in range(b - a if self.radii[t] else 0):
                own = np.flatnonzero(key >> j & 1)
                yield t, own, key[own] ^ (1 << j), False

    def first(self, apart: np.ndarray) -> np.ndarray:
        """The first table in which codes meet that differ in the bits of ``apart``; -1 for none."""
        out = np.full(len(apart), -1)
        for t in range(len(self.cuts) - 1, -1, -1):
            a, b = self.cuts[t]
            part = (apart >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            out[np.bitwise_count(part) <= self.radii[t]] = t
        return out


KEY = ["g", "t", "k", "chunk"]


def _runs(batch: pd.DataFrame, columns: list[str]) -> tuple[list[int], dict[str, np.ndarray]]:
    data = {c: batch[c].to_numpy() for c in columns}
    change = np.zeros(len(batch), bool)
    for c in (*KEY, "role"):
        change[1:] |= data[c][1:] != data[c][:-1]
    return [0, *np.flatnonzero(change).tolist(), len(batch)], data


def _searches(batches: Iterator[dict | pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, dict, dict | None]]:
    """(key, seekers, searched) of every bucket in rows sorted by KEY and role; at its end with None for searched.

    Roles: 0 seeks, 1 is searched, 2 does both. Seekers of a bucket come first, and are few enough to be held.
    """
    key, seek, both = None, None, False

    def close() -> Iterator[tuple[tuple, dict, dict | None]]:
        if seek is not None:
            if both:
                yield key, seek, seek
            yield key, seek, None

    for batch in batches:
        if not len(batch):
            continue
        bounds, data = _runs(batch, [*KEY, "role", *columns])
        for a, b in zip(bounds, bounds[1:], strict=False):
            now, role = tuple(int(data[c][a]) for c in KEY), int(data["role"][a])
            part = {c: data[c][a:b] for c in columns}
            if now != key:
                yield from close()
                key, seek, both = now, None, role == 2
            if role == 1:
                if seek is not None:
                    yield key, seek, part
            else:
                seek = part if seek is None else {c: np.concatenate([seek[c], part[c]]) for c in columns}
    yield from close()


def _meeting(tables: Tables, t: int, a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
    """Whether each pair of members counts in this bucket: it is the first in which they meet, and one is at home."""
    apart = a["code"][i].view(np.uint64) ^ b["code"][j].view(np.uint64)
    return (a["home"][i] | b["home"][j]) & (tables.first(apart) == t)


def _candidates(count: int, within: int, radius: int):
    """mapInPandas function over codes in buckets: those that meet another one, or hold several vectors, stay."""
    columns = ["code", "home", "bits", "several"]
    known: dict[int, Tables] = {}

    def tables(bits: int) -> Tables:
        if bits not in known:
            known[bits] = Tables(bits, count, within)
        return known[bits]

    def near(t: int, a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
        close = np.bitwise_count(a["code"][i] ^ b["code"][j]) <= radius
        out = np.zeros(len(i), bool)
        if close.any():
            out[close] = _meeting(tables(int(a["bits"][0])), t, a, i[close], b, j[close])
        return out

    def small(batch: pd.DataFrame, bounds: np.ndarray, data: dict) -> np.ndarray:
        """Marks of the members of whole small buckets: rows at every distance in the batch are compared at once."""
        size = np.diff(bounds)
        group = np.repeat(np.arange(len(size)), size)
        mark = np.zeros(len(batch), bool)
        for d in range(1, int(size.max(initial=1))):
            i = np.flatnonzero(group[d:] == group[:-d])
            if not len(i):
                break
            i = i[np.bitwise_count(data["code"][i] ^ data["code"][i + d]) <= radius]
            for bits in np.unique(data["bits"][i]):
                for t in np.unique(data["t"][i]):
                    own = i[(data["bits"][i] == bits) & (data["t"][i] == t)]
                    if len(own):
                        own = own[_meeting(tables(int(bits)), int(t), data, own, data, own + d)]
                        mark[own] = mark[own + d] = True
        return mark

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[pd.DataFrame] = []

        def rest() -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                bounds, data = _runs(batch, [*KEY, "role", *columns])
                bounds = np.array(bounds)
                size, role = np.diff(bounds), data["role"][bounds[:-1]]
                easy = (role == 2) & (size <= SMALL)
                easy[[0, -1]] = False  # these may go on in another batch
                keep = np.repeat(easy, size)
                if keep.any():
                    part = batch[keep]
                    own = {c: v[keep] for c, v in data.items()}
                    mark = small(part, np.concatenate([[0], np.cumsum(size[easy])]), own)
                    done.append(part.loc[mark, ["g", "t", "k", "home", "code"]])
                yield batch[~keep]
                if done:
                    out.append(pd.concat(done, ignore_index=True))
                    done.clear()

        out: list[pd.DataFrame] = []
        mark = None
        for key, seek, part in _searches(rest(), columns):
            mark = np.zeros(len(seek["code"]), bool) if mark is None else mark
            if part is None:
                if mark.any():
                    out.append(pd.DataFrame({"g": key[0], "t": key[1], "k": key[2], "home": seek["home"][mark], "code": seek["code"][mark]}))
                mark = None
            else:
                for a in range(0, len(seek["code"]), STEP):
                    for b in range(0, len(part["code"]), STEP):
                        left, right = ({c: v[x : x + STEP] for c, v in y.items()} for x, y in ((a, seek), (b, part)))
                        i, j = np.nonzero(np.bitwise_count(left["code"][:, None] ^ right["code"][None, :]) <= radius)
                        other = left["code"][i] != right["code"][j]
                        i, j = i[other], j[other]
                        mark[a + i[near(key[1], left, i, right, j)]] = True
            if out:
                yield pd.concat(out, ignore_index=True)
                out.clear()
        if out:
            yield pd.concat(out, ignore_index=True)

    return work


def _rerank(threshold: float, count: int, within: int):
    """mapInPandas function over vectors in buckets: links of every seeker, and links that join what they join."""
    columns = ["node", "n", "code", "home", "bits", "e"]

    def unit(part: dict) -> dict:
        v = np.array([np.asarray(x, np.float64) for x in part["e"]])
        v /= np.abs(v).max(1, keepdims=True)
        return part | {"v": v / np.sqrt((v * v).sum(1, keepdims=True))}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        links = whole = tables = None
        for key, seek, part in _searches(batches, columns):
            if links is None:
                links, whole = np.zeros(len(seek["node"]), np.int64), unit(seek)
                tables = Tables(int(seek["bits"][0]), count, within)
            if part is None:
                own = np.flatnonzero(links)
                if len(own):
                    out.append(pd.DataFrame({"node": seek["node"][own], "links": links[own], "root": seek["node"][own]}))
                links = None
            else:
                held = whole if part is seek else unit(part)
                for a in range(0, len(seek["node"]), STEP):
                    left = {c: v[a : a + STEP] for c, v in whole.items()}
                    for b in range(0, len(part["node"]), STEP):
                        right = {c: v[b : b + STEP] for c, v in held.items()}
                        i, j = np.nonzero(left["v"] @ right["v"].T >= threshold)
                        other = left["node"][i] != right["node"][j]
                        i, j = i[other], j[other]
                        mine = _meeting(tables, key[1], left, i, right, j)
                        i, j = i[mine], j[mine]
                        if not len(i):
                            continue
                        links[a : a + STEP] += np.bincount(i, right["n"][j], minlength=len(left["node"])).astype(np.int64)
                        ids, at = np.unique(np.concatenate([left["node"], right["node"]]), return_inverse=True)
                        label = np.arange(len(ids))
                        _merge(label, at[i], at[len(left["node"]) + j])
                        moved = np.flatnonzero(label != np.arange(len(ids)))
                        out.append(pd.DataFrame({"node": ids[moved], "links": np.zeros(len(moved), np.int64), "root": ids[label[moved]]}))
            if len(out) > 200:
                yield pd.concat(out, ignore_index=True)
                out.clear()
        if out:
            yield pd.concat(out, ignore_index=True)

    return work


def _dealt(rows: DataFrame, sizes: DataFrame, by: str, hot: int) -> DataFrame:
    """``rows`` of buckets (g, t, k) with ``chunk`` and ``role``; the seekers of a hot bucket are dealt to chunks by a
    hash of ``by``, and all its members are searched in each chunk. A bucket is hot if it has more than ``hot`` members;
    the table of hot ones is broadcast up to ``FEW_HOT`` rows and joined like others beyond that."""
    large = sizes.where(F.col("size") > hot).select("g", "t", "k", F.ceil(F.col("size") / hot).cast("int").alias("chunks"))
    large = materialise(large, "hot")
    marked = rows.join(F.broadcast(large) if large.count() <= FEW_HOT else large, ["g", "t", "k"], "left")
    own = F.pmod(F.xxhash64(F.lit(11), by), F.col("chunks")).cast("int")
    places = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("chunk"), F.lit(2).alias("role")))).otherwise(
        F.concat(
            F.array(F.struct(own.alias("chunk"), F.lit(0).alias("role"))),
            F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(1).alias("role"))),
        )
    )
    return marked.withColumn("p_", F.explode(places)).select("*", "p_.chunk", "p_.role").drop("p_", "chunks")


def link_embeddings(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    hot: int = HOT,
    sample: int = SAMPLE,
    within: int = WITHIN,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, n_links, component_id) of every row: how many other rows of its label were found with a cosine of
    ``threshold`` or more in double precision, and the smallest id that such links reach, itself included.

    Codes are cut into tables (:class:`Tables`), which find all pairs whose codes differ in ``within`` bits or fewer,
    and some of those up to ``radius`` bits; pairs of more distant codes are not found, however near their vectors
    are (README gives the recall by cosine). The exact way is ``within=64, radius=64``: all pairs of a label are decided by
    their vectors, in blocks. Codes alone travel to the tables; there, those stay that meet a code, and only their
    vectors are fetched. Every pair is decided by the original vectors, in the first bucket in which it meets, block
    by block, and never emitted. Equal vectors of a label are one node with a count. A bucket of more than ``hot``
    members is dealt to several tasks, each with its own share of the searchers.

    Ids and labels may be of any type; vectors link with those of their own length. Null, zero and non-finite
    vectors, vectors with null components and rows with a null label or id link with nothing (their component is
    their own id). Rows that repeat an id and vector link with each other; an id with several vectors has the links
    of all of them. An empty table gives an empty one.
    """
    quantisers = fit_quantisers(vectors, id_col, vec_col, sample)
    kind = vectors.schema[id_col].dataType.simpleString()
    digests = [F.xxhash64(vec_col).alias("h1"), F.xxhash64(F.lit(7), vec_col).alias("h2")]
    rows = vectors.select(
        F.col(id_col).cast("string").alias("id"),  # as a float, an id would lose digits
        F.xxhash64(F.col(label_col).cast("string"), F.size(vec_col)).alias("g"),
        *digests,
        F.when(F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.col(vec_col)).alias("e"),
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, bits = np.zeros(len(b), np.uint64), np.zeros(len(b), np.int32)
            length = np.array([0 if v is None else len(v) for v in b["e"]])
            for dim in np.unique(length[length > 0]).tolist():
                at = np.flatnonzero(length == dim)
                good, unit = unit_rows([b["e"].iloc[k] for k in at], dim)
                codes[at[good]] = quantisers[dim].codes(unit)
                bits[at[good]] = min(BITS, dim)
            yield pd.DataFrame({"id": b["id"], "g": b["g"], "h1": b["h1"], "h2": b["h2"], "code": codes.view(np.int64), "bits": bits})

    found = rows.mapInPandas(encode, "id string, g long, h1 long, h2 long, code long, bits int")
    coded = materialise(found.withColumn("id", F.col("id").cast(kind)), "codes")
    whole = coded.where("bits > 0")
    nodes = whole.groupBy("g", "h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("code").alias("code"), F.first("bits").alias("bits"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    cells = materialise(nodes.groupBy("g", "code").agg(F.first("bits").alias("bits"), (F.count(F.lit(1)) > 1).alias("several"), F.count(F.lit(1)).alias("n")), "cells")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bits in b["bits"].unique().tolist():
                own = b[b["bits"] == bits]
                for t, at, key, home in Tables(bits, count, within).entries(own["code"].to_numpy().view(np.uint64)):
                    part = own.iloc[at]
                    yield pd.DataFrame({"g": part["g"], "t": t, "k": key, "home": home, "code": part["code"], "bits": bits, "several": part["several"]})

    schema = "g long, t int, k long, home boolean, code long, bits int, several boolean"
    light = cells.select("g", "code", "bits", "several")
    sampled = light.where(F.pmod(F.xxhash64(F.lit(3), "code"), F.lit(SHARE)) == 0).mapInPandas(spread, schema)
    sizes = sampled.groupBy("g", "t", "k").agg((F.count(F.lit(1)) * SHARE).alias("size"))
    dealt = _dealt(light.mapInPandas(spread, schema), sizes, "code", hot)
    order = [*KEY, "role"]
    met = dealt.repartition(*KEY).sortWithinPartitions(*order).mapInPandas(_candidates(count, within, radius), "g long, t int, k long, home boolean, code long")
    alone = cells.where("several").mapInPandas(
        lambda batches: (x[x["home"] & (x["t"] == 0)] for x in spread(b[["g", "code", "bits", "several"]] for b in batches)), schema
    )
    met = materialise(met.union(alone.select("g", "t", "k", "home", "code")).distinct(), "met")
    counts = hot_keys(cells, ["g", "code"], "n")
    members = salted_join(nodes.select("g", "code", "bits", "node", "n", "h1", "h2"), met, ["g", "code"], counts, "node")
    members = materialise(members.select("g", "t", "k", "home", "code", "bits", "node", "n", "h1", "h2"), "members")
    needed = members.select("h1").distinct()
    index = bit_map(needed, "h1", needed.count())

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[index.may_have(b["h1"].to_numpy().view(np.uint64))]

    element = vectors.schema[vec_col].dataType.simpleString()
    own = vectors.where(F.col(vec_col).isNotNull()).select(*digests, F.col(vec_col).alias("e"))
    own = own.mapInPandas(fetch, f"h1 long, h2 long, e {element}").groupBy("h1", "h2").agg(F.first("e").alias("e"))
    sizes = members.groupBy("g", "t", "k").agg(F.count(F.lit(1)).alias("size"))
    placed = _dealt(members, sizes, "node", hot).join(own, ["h1", "h2"])
    placed = placed.select(*KEY, "role", "home", "code", "bits", "node", "n", "e").repartition(*KEY).sortWithinPartitions(*order)
    found = materialise(placed.mapInPandas(_rerank(threshold, count, within), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select("node", "root")).select(F.col("node").alias("m"), "root")
    rooted = nodes.join(links, "node", "left").join(roots, F.col("node") == F.col("m"), "left")
    rooted = rooted.select("g", "h1", "h2", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    known = rooted.join(least, "root").select("g", "h1", "h2", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component")
    linked = salted_join(whole.select("id", "g", "h1", "h2"), known, ["g", "h1", "h2"], hot_keys(nodes, ["g", "h1", "h2"], "n"), "id")
    others = coded.where("bits = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.select("id", "n_links", "component").union(others).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"))
