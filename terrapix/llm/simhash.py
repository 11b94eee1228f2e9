"""SimHash fingerprints and their links within a Hamming radius by BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialise

BITS = 64
BLOCK = 1 << 14
HOT = 1 << 16
"""Fingerprints of a shard from which on pairs of its blocks are shards of their own."""
SHARE = 16
"""Hot shards are recognised by every 16th fingerprint; that only tells how the work is dealt."""


def words_of(text: str | None) -> list[bytes]:
    """Words between the bytes 0x20 and 0x09-0x0D, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words where they are fewer; none for none."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for no hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def simhash(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null and empty texts have 0."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(words_of(t), shingle)) for t in batch["t"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": found.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("t"))  # as a float, an id would lose digits
    found = chosen.mapInPandas(work, "id string, fp bigint")
    return found.select(F.col("id").cast(kind).alias("id"), "fp")


class BkTree:
    """A BK-tree over distinct fingerprints: each child hangs on the edge of its Hamming distance to the parent.

    It is built level by level: the first fingerprint of a group is its root, the others go to the child of
    their distance. Children of a node lie next to each other, ordered by edge.
    """

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps
        n = len(fps)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        left, root = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(left):
            d = np.bitwise_count(fps[left] ^ fps[root]).astype(np.int64)
            group = root * (BITS + 1) + d
            _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
            chosen = left[first]
            parent[chosen], edge[chosen] = root[first], d[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, root = left[rest], chosen[inverse[rest]]
        key = np.where(parent >= 0, parent * (BITS + 1) + edge, -1)
        self.child = np.argsort(key, kind="stable")
        self.key = key[self.child]
        self.edge = edge[self.child]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, node) within ``radius``; only edges within it of a node's distance are followed."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_q, found_n = [], []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.key, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.key, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            size = high - low
            q = np.repeat(q, size)
            at = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            node = self.child[at]
        return np.concatenate(found_q), np.concatenate(found_n)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair in ``label``, an array that maps to the least member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked_groups(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints the number of the least one that each reaches by links within ``radius``."""
    label, tree = np.arange(len(fps)), BkTree(fps)
    step = max(1, (1 << 22) // len(fps))
    for k in range(0, len(fps), step):
        q, node = tree.near(fps[k : k + step], radius)
        _merge(label, q + k, node)
    return label


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - radius`` of ``blocks`` bit ranges: two fingerprints within the radius
    differ in ``radius`` ranges at most, so they agree under one mask at least."""
    cut = [round(k * BITS / blocks) for k in range(blocks + 1)]
    ranges = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(x) for x in combinations(ranges, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(keyed: DataFrame, hot: int) -> DataFrame:
    """``keyed`` (t, k, fp) with ``cell``: 0, but in a hot shard one row for every pair of blocks that has the row's block.

    Each two fingerprints of a shard meet in one cell, of two blocks of about ``hot`` fingerprints at most. A shard is
    hot if it has more than ``hot`` and more than one in 10,000 of all rows, so the table of them may be broadcast.
    """
    counts = keyed.where(F.pmod(F.xxhash64(F.lit(3), "fp"), F.lit(SHARE)) == 0).groupBy("t", "k").agg((F.count(F.lit(1)) * SHARE).alias("c_"))
    total = counts.agg(F.sum("c_").alias("all_"))
    large = counts.crossJoin(F.broadcast(total)).where((F.col("c_") > hot) & (F.col("c_") * 10_000 > F.col("all_")))
    marked = keyed.join(F.broadcast(large.select("t", "k", F.ceil(F.col("c_") / hot).cast("int").alias("n_"))), ["t", "k"], "left")
    own = F.pmod(F.xxhash64(F.lit(4), "fp"), F.col("n_")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_") - 1), lambda i: F.least(i, own) * F.col("n_") + F.greatest(i, own))
    return marked.withColumn("cell", F.explode(F.when(F.col("n_").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("n_")


def fingerprint_edges(fps: DataFrame, radius: int = 3, blocks: int | None = None, fp_col: str = "fp", hot: int = HOT) -> DataFrame:
    """Edges (u, v) that join just those distinct fingerprints which links within ``radius`` bits join.

    Fingerprints that agree under one of the masks meet in a shard; every shard with two or more gets a
    BK-tree, which all its members query. A shard yields one edge per member at most, to the least one it
    reaches there, so that a dense group costs as many rows as it has members and not their pairs. A shard of more
    than ``hot`` fingerprints is dealt to several tasks (:func:`_cells`).
    """
    masks = [_signed(m) for m in block_masks(radius, blocks or radius + 2)]
    tables = F.explode(
        F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(masks)])
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        last = None

        def shard(parts: list[np.ndarray]) -> pd.DataFrame | None:
            own = np.unique(np.concatenate(parts)).view(np.uint64)
            if len(own) < 2:
                return None
            to = linked_groups(own, radius)
            moved = to != np.arange(len(own))
            return pd.DataFrame({"u": own[moved].view(np.int64), "v": own[to[moved]].view(np.int64)}) if moved.any() else None

        for batch in batches:
            t, k, cell, fp = (batch[c].to_numpy() for c in ("t", "k", "cell", "fp"))
            if not len(t):
                continue
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (cell[1:] != cell[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(t)]])
            out = []
            if held and last != (t[0], k[0], cell[0]):
                out.append(shard(held))
                held = []
            size = np.diff(bounds)
            todo = set(np.flatnonzero(size > 1).tolist()) | {0, len(size) - 1}  # single ones have no links
            for g in sorted(todo):
                part = fp[bounds[g] : bounds[g + 1]]
                if g == len(size) - 1:
                    held.append(part)
                elif g == 0:
                    out.append(shard([*held, part]))
                    held = []
                else:
                    out.append(shard([part]))
            last = (t[-1], k[-1], cell[-1])
            out = [x for x in out if x is not None]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held and (x := shard(held)) is not None:
            yield x

    keyed = fps.select(F.col(fp_col).alias("fp")).select("fp", tables.alias("s")).select("s.t", "s.k", "fp")
    order = ["t", "k", "cell"]
    dealt = _cells(keyed, hot).select(*order, "fp")
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(work, "u bigint, v bigint")


def simhash_groups(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) of every row: its fingerprint and the smallest id that links within ``radius`` reach.

    Rows with equal fingerprints are one node, so that copies cost nothing after the first pass. Null and
    empty texts have the fingerprint 0 and link like any other; repeated rows have equal results; null ids are
    never a component's id, which is null if a component has no other; an empty table gives an empty one.
    """
    found = materialise(simhash(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(fingerprint_edges(nodes, radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return found.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
