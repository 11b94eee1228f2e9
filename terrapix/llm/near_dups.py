"""Near-duplicate documents by whole shingle sets: candidates share a rare shingle, links are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bit_map
from .components import components
from .scratch import materialise, small_batches
from .simhash import fingerprint, fingerprint_edges, words_of

SAMPLE = 8192
"""Documents from which common shingles are learnt; those only go last in the order of shingles, whatever is learnt."""
COMMON = 3
"""Documents of the sample from which on a shingle is common."""
MOST = 1 << 18
"""Common shingles that are told to the tasks at most."""
PAIRS = 16
"""Pairs for each node up to which all that are left meet at once."""
HUBS = (1, 4, 16)
"""Hubs of a key in rounds that come before; after them, or after one that halves nothing, all that are left meet."""
PARITY = 1024
"""Bits of a set's parities at least; a set of more members has as many bits, rounded up to a power of two."""
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, 3)
        return h


def shingles(text: str | None, size: int, seen: _Words) -> np.ndarray:
    """A hash of every run of ``size`` words, repeats included; of all words where they are fewer; none for none."""
    words = words_of(text)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def prefix_size(n: int, min_similarity: float) -> int:
    """Of a set of ``n``, so many first members that one is shared with the first members of every similar set.

    A similar set shares ``min_similarity * n`` members at least, in any order that all sets have in common.
    """
    return n - int(np.ceil(min_similarity * n - 1e-9)) + 1 if n else 0


def prefix(own: np.ndarray, common: np.ndarray, min_similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first members of a set, those in ``common`` (ascending) last and else by a hash: (others, common ones)."""
    at = np.searchsorted(common, own)
    last = common[np.minimum(at, len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
    chosen = np.lexsort((_mixed(own), last))[: prefix_size(len(own), min_similarity)]
    return own[chosen[~last[chosen]]], own[chosen[last[chosen]]]


def parities(own: np.ndarray) -> bytes:
    """For each of so many parts that a hash deals a set into, whether its size is odd.

    Two sets have as many members apart at least as they have bits apart.
    """
    bits = max(PARITY, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits(np.bincount((_mixed(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole sets in ascending order; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _common_shingles(chosen: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of several documents of a sample, the most common ``MOST`` at most, in ascending order."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Words()
        for b in batches:
            for text in b["t"]:
                yield pd.DataFrame({"h": np.unique(shingles(text, shingle, seen)).view(np.int64)})

    rows = max(1, chosen.count())
    sample = chosen.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(rows)) < SAMPLE)
    counts = sample.mapInPandas(hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON)
    found = counts.orderBy(F.desc("c"), "h").limit(MOST).select("h").toPandas()["h"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


class _Decider:
    """Which pairs of nodes are similar: sizes and parities drop pairs that they prove apart, whole sets decide the rest."""

    def __init__(self, nodes: DataFrame, chosen: DataFrame, kind: str, shingle: int, min_similarity: float) -> None:
        self.nodes, self.chosen, self.kind, self.shingle, self.least = nodes, chosen, kind, shingle, min_similarity

    @staticmethod
    def _with(pairs: DataFrame, side: str, other: DataFrame) -> DataFrame:
        """A hub has many pairs, but they are only as many as its key has members; adaptive execution splits them."""
        return pairs.join(other.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in other.columns]), side)

    def _possible(self, pairs: DataFrame) -> DataFrame:
        least = self.least

        def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                apart = np.array([bits_apart(a, b) for a, b in zip(p["odd_a"], p["odd_b"], strict=True)], np.int64)
                most = (p["n_a"] + p["n_b"]).to_numpy() * ((1 - least) / (1 + least)) + 1e-6
                yield p.loc[apart <= most, ["a", "b"]]

        for side in ("a", "b"):
            pairs = self._with(pairs, side, self.nodes.select("node", "n", "odd"))
        sized = pairs.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-6)
        return sized.mapInPandas(possible, f"a {self.kind}, b {self.kind}")

    def _sets(self, pairs: DataFrame, count: int) -> DataFrame:
        """(node, whole) of the nodes of ``pairs``, from their texts; a bit map tells the tasks which texts to read."""
        needed = pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h"))
        index, shingle = bit_map(needed, "h", 2 * count), self.shingle

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = _Words()
            for b in batches:
                b = b[index.may_have(b["h"].to_numpy(np.int64).view(np.uint64))]
                own = [np.unique(shingles(t, shingle, seen)) for t in b["t"]]
                yield pd.DataFrame({"node": b["id"], "sum": [int(x.sum(dtype=np.uint64).view(np.int64)) for x in own], "whole": [x.tobytes() for x in own]})

        keyed = self.chosen.select(F.xxhash64("id").alias("h"), "id", "t")
        return keyed.mapInPandas(whole, f"node {self.kind}, sum long, whole binary").dropDuplicates(["node", "sum"]).select("node", "whole")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of ``pairs`` (a, b), stored."""
        pairs = materialise(self._possible(pairs.distinct()), "possible")
        if not (count := pairs.count()):
            return pairs
        sets, least = self._sets(pairs, count), self.least

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                both = zip(p["whole_a"], p["whole_b"], strict=True)
                good = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in both]
                yield p.loc[good, ["a", "b"]]

        for side in ("a", "b"):
            pairs = self._with(pairs, side, sets)
        found = pairs.select("a", "b", "whole_a", "whole_b").mapInPandas(decide, f"a {self.kind}, b {self.kind}")
        return materialise(found, "links")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")


def _firm() -> Column:
    return F.col("u") >= F.col("n")


def _alive() -> Column:
    return _firm() | ((F.col("u") >= F.col("low")) & (F.col("n") <= F.col("high")))


def _ends(how=lambda x: x) -> dict:
    """Of a key: the members, the least size and the greatest ``u`` of firm ones."""
    return {"all": how(F.count(F.lit(1))), "low": how(F.min(F.when(_firm(), F.col("n")))), "high": how(F.max(F.when(_firm(), F.col("u"))))}


def _entries(nodes: DataFrame, min_similarity: float) -> DataFrame:
    """(key, node, n, u) of the first members of every node's set that others have too.

    A pair whose first common key is this one shares n - at members of either set at most, so a partner's size is
    ``u`` at most. If a member's ``u`` is below its own size n, a partner's is above, which makes that one firm; a
    key's members that no firm one can be a partner of are left out.
    """
    c = min_similarity / (1 + min_similarity)
    columns = ["key", "node", "n", ((F.col("n") - F.col("at")) / c - F.col("n") + 1e-6).alias("u")]
    rare = nodes.select("node", "n", F.posexplode("rare").alias("at", "key")).select(*columns)
    often = nodes.select("node", "n", F.size("rare").alias("before"), F.posexplode("often").alias("k", "key"))
    often = often.withColumn("at", F.col("before") + F.col("k")).select(*columns)
    same = Window.partitionBy("key")
    rare = rare.withColumns(_ends(lambda x: x.over(same)))
    ends = often.groupBy("key").agg(*[v.alias(k) for k, v in _ends().items()])
    often = often.join(ends, "key")
    kept = [x.where((F.col("all") > 1) & _alive()).select("key", "node", "n", "u") for x in (rare, often)]
    return materialise(kept[0].union(kept[1]), "entries")


def near_duplicate_groups(
    docs: DataFrame, shingle: int = 5, min_similarity: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, component_id) of every row with an id: the smallest id that links of near duplicates reach.

    Two documents are near duplicates if their sets of ``shingle``-word shingles have a Jaccard similarity of
    ``min_similarity`` or more. Documents with equal sets are one node. All pairs of similar sets are
    candidates: in an order of shingles that all sets share, the first ``prefix_size`` members of two similar sets
    have one in common, a key. Common shingles go last in that order, so that they are keys of few documents.
    Whole sets decide every candidate. Whole SimHash fingerprints within ``radius`` bits (BK-trees) only name
    pairs to try first.

    Members of a key that are in one component do not meet, nor do those whose sizes and places of the key prove
    them apart (the first key of a similar pair passes). While the pairs left are many, the members of a key meet
    hubs, first the one with the fewest shingles of its own, and a hub that met all others leaves its key; then all
    that are left meet, so none is untried.

    Null and empty texts are one group. Rows with null ids are in no group. Rows that repeat an id are one
    document. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(chosen, shingle))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Words()
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["t"], strict=True):
                h = shingles(text, shingle, seen)
                own = np.unique(h)
                s1, s2 = _mixed(own).sum(dtype=np.uint64), _mixed(own ^ MIX).sum(dtype=np.uint64)
                rare, often = (x.view(np.int64) for x in prefix(own, common.value, min_similarity))
                rows.append((key, int(s1.view(np.int64)), int(s2.view(np.int64)), fingerprint(h), len(own), parities(own), rare, often))
            frame = pd.DataFrame(rows, columns=["id", "s1", "s2", "fp", "n", "odd", "rare", "often"])
            frame["fp"] = np.array(frame["fp"].tolist(), np.uint64).view(np.int64)
            yield frame

    found = materialise(
        chosen.mapInPandas(work, f"id {kind}, s1 long, s2 long, fp long, n int, odd binary, rare array<long>, often array<long>"), "sets"
    )
    first = [F.first(c).alias(c) for c in ("fp", "n", "odd", "rare", "often")]
    nodes = materialise(found.groupBy("s1", "s2").agg(F.min("id").alias("node"), *first), "nodes")
    entries, decider = _entries(nodes, min_similarity), _Decider(nodes, chosen, kind, shingle, min_similarity)
    prints = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same_print = nodes.join(prints, "fp").where("node > first").select("node", "first")
    near = fingerprint_edges(prints, radius)
    by_print = near.join(prints.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(
        prints.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v"
    )
    edges = decider.similar(_ordered(by_print.select("a", "b").union(same_print), "a", "b"))
    limit, turn, before, last = PAIRS * nodes.count(), 0, None, False
    columns = ["node", "n", "u", "root"]
    possible = (F.col("root") != F.col("hub_root")) & (F.col("n") <= F.col("hub_u")) & (F.col("hub_n") <= F.col("u"))
    entries = entries.withColumn("root", F.col("node"))  # in the first round all meet their hubs
    while True:
        if last:
            others = entries.where(_firm()).select("key", *[F.col(c).alias(f"hub_{c}") for c in columns])
            pairs = entries.join(others, "key").where(possible & ~(_firm() & (F.col("node") <= F.col("hub_node"))))
        else:
            hubs = [F.max(F.struct((F.col("u") - F.col("n")).alias("turn"), *columns)).alias("h0")]
            hubs += [F.min(F.struct(F.xxhash64(F.lit(turn * 100 + k), "node").alias("turn"), *columns)).alias(f"h{k}") for k in range(1, HUBS[turn])]
            each = [F.struct(*[F.col(f"h{k}.{c}").alias(c) for c in columns]) for k in range(HUBS[turn])]
            heads = entries.where(_firm()).groupBy("key").agg(*hubs).select("key", F.array_distinct(F.array(*each)).alias("hubs"))
            both = entries.join(materialise(heads, "hubs"), "key")
            pairs = both.select(*columns, F.explode("hubs").alias("x")).select(*columns, *[F.col(f"x.{c}").alias(f"hub_{c}") for c in columns])
            pairs = pairs.where(possible)
            entries = materialise(both.where(~F.array_contains(F.col("hubs.node"), F.col("node"))).select("key", "node", "n", "u"), "entries")
            turn += 1
        edges = edges.union(decider.similar(_ordered(pairs, "node", "hub_node")))
        roots = components(edges)
        if last:
            break
        placed = entries.join(roots, "node", "left").select("key", "node", "n", "u", F.coalesce("root", "node").alias("root"))
        by_root = placed.groupBy("key", "root").agg(F.count_if(_firm()).alias("firm"), *[v.alias(k) for k, v in _ends().items()])
        live = by_root.groupBy("key").agg(
            (F.sum("all") * F.sum("firm") - F.sum(F.col("all") * F.col("firm"))).alias("apart"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        live = materialise(live.where("apart > 0"), "live")
        apart = live.agg(F.sum("apart")).first()[0]
        if not apart:
            break
        last = apart <= limit or turn == len(HUBS) or (before is not None and 2 * apart > before)
        before = apart
        entries = materialise(placed.join(live.select("key", "low", "high"), "key").where(_alive()).select("key", *columns), "entries")
    labels = nodes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component_id"))
    return found.select("id", "s1", "s2").join(labels, ["s1", "s2"]).select(F.col("id").alias(id_col), "component_id")


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 5, min_similarity: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows with a null id stay."""
    groups = near_duplicate_groups(docs, shingle, min_similarity, radius, id_col, text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
