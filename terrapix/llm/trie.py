"""The prefix trie of conversations: double arrays of prefix shards, whose shared upper nodes are merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked_prefix
from .double_array import DoubleArray, ranks
from .scratch import materialise
from .skew import hot_keys, salted_join

STRETCH = 64
"""Turns of a conversation that are held together; a longer one is cut."""
RUN = 1024
SHARD_TURNS = 1 << 17
"""Turns of one double array, about."""
LONG = 1 << 16
"""A conversation with more turns is ordered in ranges over many tasks."""
IDS = 4096
KEY = ["depth", "d1", "d2"]
"""A node: its depth and 128 bits over the turns that lead to it."""


def turn_keys(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, o, t1, t2, bytes, rid): conversation, turn number, 128 bits of role and text, UTF-8 bytes of the text.

    A null role or text is empty; rows without a conversation are left out. From here on no text is shuffled.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    half = lambda seed: F.xxhash64(F.lit(seed), role, text)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"),
        F.col(turn_col).cast("long").alias("o"),
        half(11).alias("t1"),
        half(12).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("rid"),
    )
    return materialise(rows, "turns")


def in_order(keys: DataFrame) -> DataFrame:
    """(c, pos, t1, t2, bytes): turns by number, null first; turns of one number by the hash of role and text."""
    counts = keys.groupBy("c").agg(F.count(F.lit(1)).alias("k_")).where(F.col("k_") > LONG).select("c")
    columns = ["c", "pos", "t1", "t2", "bytes"]
    inside = Window.partitionBy("c").orderBy(F.col("o").asc_nulls_first(), "t1", "t2")
    if counts.isEmpty():
        return materialise(keys.withColumn("pos", F.row_number().over(inside).cast("long") - 1).select(*columns), "placed")
    long = materialise(counts, "long")
    usual = keys.join(long, "c", "left_anti").withColumn("pos", F.row_number().over(inside).cast("long") - 1)
    near = F.coalesce(F.col("o").cast("double"), F.lit(float("-inf")))
    rest = F.coalesce(F.col("o").cast("decimal(20,0)") - F.col("o").cast("double").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    word, mixed = F.lit(Decimal(1 << 64)), F.pmod(F.xxhash64("rid"), F.lit(1 << 24)).cast("decimal(8,0)")
    exact = ((rest.cast("decimal(5,0)") * word + F.col("t1").cast("decimal(19,0)")).cast("decimal(28,0)") * F.lit(1 << 24).cast("decimal(8,0)")).cast("decimal(37,0)")
    many = keys.join(F.broadcast(long), "c", "left_semi") if long.count() < 1000 else keys.join(long, "c", "left_semi")
    many = many.withColumns({"near_": near, "key_": (exact + mixed).cast("decimal(38,0)")})
    ranked = ranked_prefix(many, "near_", "key_", [], descending=False, by=["c"]).withColumn("pos", F.col("rank").cast("long") - 1)
    return materialise(usual.select(*columns).union(ranked.select(*columns)), "placed")


def graft_heads(placed: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every conversation c with its first ``head`` turns replaced by the first ``head`` turns of conversation ``base``.

    ``base`` and ``head`` (at most ``most``) are expressions of c. Fewer turns of the base give all of them, a base that
    is not there none. Conversations that lose all turns are not in the result.
    """
    sizes = materialise(placed.groupBy("c").agg(F.count(F.lit(1)).alias("k_")), "sizes")
    convs = sizes.select("c", base.alias("b_"), head.cast("long").alias("h_"))
    heads = sizes.select(F.col("c").alias("b_"), F.least("k_", F.lit(most)).alias("kb_"))
    convs = materialise(convs.join(heads, "b_", "left").withColumn("taken_", F.least("h_", F.coalesce("kb_", F.lit(0)))), "heads")
    own = salted_join(placed, convs, ["c"], hot_keys(sizes, ["c"], "k_"), "pos").where("pos >= h_")
    own = own.select("c", (F.col("pos") - F.col("h_") + F.col("taken_")).alias("pos"), "t1", "t2", "bytes")
    first = placed.where(F.col("pos") < most).select(F.col("c").alias("b_"), "pos", "t1", "t2", "bytes")
    grafted = first.join(convs.select("b_", "c", "h_"), "b_").where("pos < h_").select("c", "pos", "t1", "t2", "bytes")
    return own.unionByName(grafted)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(t1: np.ndarray, t2: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for turns at their positions; a prefix has the exclusive or of those of its turns, in any order."""
    p = pos.astype(np.uint64)
    one, two = _mixed(t1.view(np.uint64) ^ _mixed(p)), _mixed(t2.view(np.uint64) + _mixed(~p))
    return one.view(np.int64), two.view(np.int64)


def _flat(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64)


def _summed(batches: Iterator[pd.DataFrame], stretch: int) -> Iterator[pd.DataFrame]:
    """Stretches with their length, digest and bytes."""
    for b in batches:
        size = b["t1"].map(len).to_numpy(np.int64)
        owner = np.repeat(np.arange(len(b)), size)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b["j"].to_numpy() * stretch, size)
        out = b.assign(size=size)
        for name, x in zip(("x1", "x2"), _digests(_flat(b["t1"]), _flat(b["t2"]), pos), strict=True):
            total = np.zeros(len(b), np.int64)
            np.bitwise_xor.at(total, owner, x)
            out[name] = total
        total = np.zeros(len(b), np.int64)
        np.add.at(total, owner, _flat(b["b"]))
        out["total"] = total
        yield out[["c", "j", "t1", "t2", "b", "size", "x1", "x2", "total"]]


def _stretches(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows of up to ``STRETCH`` turns: conversation, number, arrays of keys and bytes, digests of the prefixes at the
    start (s1, s2) and end (e1, e2), and bytes before the start. Every conversation has a stretch 0, maybe without turns."""
    width = STRETCH
    turn = F.struct("pos", "t1", "t2", "bytes")
    marks = convs.select("c", F.lit(0).cast("long").alias("j"), F.lit(None).cast(placed.select(turn.alias("x")).schema["x"].dataType).alias("x"))
    rows = placed.select("c", F.floor(F.col("pos") / width).cast("long").alias("j"), turn.alias("x")).union(marks)
    grouped = rows.groupBy("c", "j").agg(F.array_sort(F.collect_list("x")).alias("x"))  # ``STRETCH`` turns at most
    grouped = grouped.select("c", "j", *[F.col(f"x.{a}").alias(z) for a, z in (("t1", "t1"), ("t2", "t2"), ("bytes", "b"))])
    arrays = "t1 array<long>, t2 array<long>, b array<long>"
    found = grouped.mapInPandas(lambda it: _summed(it, width), f"c long, j long, {arrays}, size long, x1 long, x2 long, total long")
    found = materialise(found, "stretches")
    goes_on = (F.col("j") > 0) | (F.col("size") == width)
    zero = F.lit(0).cast("long")
    single = found.where(~goes_on).withColumns({"s1": zero, "s2": zero, "before": zero})
    light = found.where(goes_on).select("c", "j", F.floor(F.col("j") / RUN).alias("r"), "x1", "x2", "total")
    sums = lambda w: [F.coalesce(f(x).over(w), zero).alias(n) for n, f, x in (("s1", F.bit_xor, "x1"), ("s2", F.bit_xor, "x2"), ("before", F.sum, "total"))]
    past = lambda *by: Window.partitionBy(*by)
    earlier = lambda by, o: past(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    runs = light.groupBy("c", "r").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("total").alias("total"))
    runs = runs.select("c", "r", *[x.alias(f"r{i}") for i, x in enumerate(sums(earlier(["c"], "r")))])
    inner = light.select("c", "r", "j", *sums(earlier(["c", "r"], "j"))).join(runs, ["c", "r"])
    starts = inner.select("c", "j", F.col("s1").bitwiseXOR(F.col("r0")).alias("s1"), F.col("s2").bitwiseXOR(F.col("r1")).alias("s2"), (F.col("before") + F.col("r2")).alias("before"))
    out = single.unionByName(found.where(goes_on).join(starts, ["c", "j"]))
    out = out.withColumns({"e1": F.col("s1").bitwiseXOR(F.col("x1")), "e2": F.col("s2").bitwiseXOR(F.col("x2"))})
    return materialise(out.drop("x1", "x2"), "placed_stretches")


PATH = ["j", "s1", "s2", "e1", "e2", "size"]
"""What equal stretches after equal prefixes have in common."""


def _walk(pdf: pd.DataFrame, sums: list[str], least: list[str], stretch: int) -> pd.DataFrame:
    """The nodes of one shard: its stretches are packed into a double array, which all of them then walk together.

    The first symbol of a stretch is the prefix before it, the others are its turns. A node gets the sums and least
    values of the stretches that pass it.
    """
    size = pdf["size"].to_numpy(np.int64)
    start, n_start = ranks(*[pdf[c].to_numpy(np.int64) for c in ("j", "s1", "s2")])
    t1, t2, width = _flat(pdf["t1"]), _flat(pdf["t2"]), _flat(pdf["b"])
    turn, n_turn = ranks(t1, t2)
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    symbols = np.empty(offsets[-1], np.int64)
    first = np.zeros(len(symbols), bool)
    first[offsets[:-1]] = True
    symbols[first], symbols[~first] = start, n_start + turn
    trie = DoubleArray(offsets, symbols, n_start + n_turn)
    named = ["depth", "d1", "d2", "p1", "p2", "bytes", "before"]
    nodes = {n: np.zeros(len(trie.check), np.int64) for n in [*named, *sums]} | {n: np.full(len(trie.check), np.iinfo(np.int64).max) for n in least}
    shown = np.zeros(len(trie.check), bool)
    at, depth = np.zeros(len(pdf), np.int64), pdf["j"].to_numpy(np.int64) * stretch
    x1, x2, spent = (pdf[c].to_numpy(np.int64).copy() for c in ("s1", "s2", "before"))
    begin = np.cumsum(size) - size
    for level in range(int(size.max(initial=0)) + 1):
        here = np.flatnonzero(size >= level)
        slots = trie.step(at[here], symbols[offsets[here] + level])
        if (slots < 0).any():
            raise AssertionError("a path that is not in its own trie")
        at[here] = slots
        if level:
            turn_at = begin[here] + level - 1
            nodes["p1"][slots], nodes["p2"][slots] = x1[here], x2[here]
            a, b = _digests(t1[turn_at], t2[turn_at], depth[here] + level - 1)
            x1[here] ^= a
            x2[here] ^= b
            nodes["before"][slots], nodes["bytes"][slots] = spent[here], width[turn_at]
            spent[here] += width[turn_at]
            shown[slots] = True
        else:
            shown[slots] = depth[here] == 0  # the start of a later stretch is the end of the one before it
        nodes["depth"][slots], nodes["d1"][slots], nodes["d2"][slots] = depth[here] + level, x1[here], x2[here]
        for n in sums:
            np.add.at(nodes[n], slots, pdf[n].to_numpy(np.int64)[here])
        for n in least:
            np.minimum.at(nodes[n], slots, pdf[n].to_numpy(np.int64)[here])
    return pd.DataFrame({n: x[shown] for n, x in nodes.items()})


def _tally(paths: DataFrame, turns: int, sums: list[str], least: list[str]) -> DataFrame:
    """Nodes with sums and least values over the paths through them.

    Paths are dealt by ranges of their prefixes, so that a shard holds neighbours in the trie and shares with others
    only the nodes above its ends; those are merged here, by their digests.
    """
    stretch, limit = STRETCH, SHARD_TURNS
    columns = [*PATH, "t1", "t2", "b", "before", *sums, *least]
    dealt = paths.select(*columns).repartitionByRange(max(1, -(-turns // limit)), "j", "s1", "s2", "t1")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += int(b["size"].sum()) + len(b)
            if size > 2 * limit:
                yield _walk(pd.concat(held, ignore_index=True), sums, least, stretch)
                held, size = [], 0
        if held:
            yield _walk(pd.concat(held, ignore_index=True), sums, least, stretch)

    about = ["p1", "p2", "bytes", "before"]
    nodes = dealt.mapInPandas(work, ", ".join(f"{c} long" for c in [*KEY, *about, *sums, *least]))
    totals = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in least] + [F.min(c).alias(c) for c in about]
    return nodes.groupBy(*KEY).agg(*totals)


def _ends(finals: DataFrame) -> DataFrame:
    """SHA-256 of the ids, ascending and comma-joined, of the conversations that end at each node.

    Ids are dealt by ranges of node and id and joined there to texts of ``IDS`` ids; then a node's texts are digested in
    their order as a stream, which holds one of them at a time.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = np.flatnonzero((b[KEY].diff() != 0).any(axis=1).to_numpy())
            cuts = [k for a, z in zip(new, [*new[1:], len(b)], strict=True) for k in range(a, z, IDS)]
            ids = b["c"].astype(str).tolist()
            out = b.iloc[cuts].copy()
            out["part"] = [",".join(ids[a : min(z, a + IDS)]) for a, z in zip(cuts, [*cuts[1:], len(b)], strict=True)]
            yield out

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for *key, part in zip(*[b[k] for k in KEY], b["part"], strict=True):
                if key == last:
                    state.update(b"," + part.encode())
                    continue
                if last is not None:
                    out.append([*last, state.hexdigest()])
                last, state = key, hashlib.sha256(part.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([[*last, state.hexdigest()]], columns=[*KEY, "ends_sha256"])

    kind = "depth long, d1 long, d2 long"
    dealt = finals.select(*KEY, "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c")
    joined = dealt.mapInPandas(texts, f"{kind}, c long, part string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInPandas(digests, f"{kind}, ends_sha256 string")


def trie_nodes(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``placed`` (c, pos, t1, t2, bytes); ``convs`` (c) has all conversations, turnless ones too.

    Stretches of ``STRETCH`` turns that are equal after equal prefixes become one path with a count. Double arrays of
    prefix shards give each node's members and the smallest of them; merged, they tell which conversation is a node's
    first, and so what a conversation adds to the sums of a subtree: the bytes of its turns up to where it is the first
    one (q), and one leaf if it is the first to end at a leaf. A second walk adds these up over the members of a node.
    """
    stretches = _stretches(placed, convs)
    paths = stretches.groupBy(*PATH).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("m"), *[F.first(x).alias(x) for x in ("t1", "t2", "b", "before")])
    paths = materialise(paths, "paths")
    turns = paths.agg(F.coalesce(F.sum("size") + F.count(F.lit(1)), F.lit(0)).alias("k")).first().k
    nodes = materialise(_tally(paths, turns, ["n"], ["m"]), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialise(nodes, "counted")
    own = nodes.groupBy("m").agg(F.min("before").alias("q"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.count(F.lit(1)).alias("k_"))
    own = materialise(own, "firsts")

    last = F.max_by(F.struct((F.col("j") * STRETCH + F.col("size")).alias("depth"), F.col("e1").alias("d1"), F.col("e2").alias("d2"), (F.col("before") + F.col("total")).alias("total")), "j")
    finals = materialise(stretches.groupBy("c").agg(last.alias("x"), F.count(F.lit(1)).alias("k_")).select("c", "x.*", "k_"), "finals")
    adds = finals.join(own.drop("k_").withColumnRenamed("m", "c"), "c", "left")
    adds = adds.select("c", F.coalesce("q", "total").alias("q"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    added = salted_join(stretches.select("c", *PATH), adds, ["c"], hot_keys(finals, ["c"], "k_"), "j")
    added = added.groupBy(*PATH).agg(F.sum("q").alias("q"), F.sum("leaf").alias("leaf"))
    sums = _tally(paths.join(added, PATH), turns, ["q", "leaf"], []).select(*KEY, F.col("q").alias("qs"), F.col("leaf").alias("n_leaves"))

    out = nodes.join(sums, KEY).join(_ends(finals), KEY, "left")
    out = salted_join(materialise(out, "summed"), own.select("m", "q"), ["m"], hot_keys(own, ["m"], "k_"), "depth")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("m").alias("parent_conv_id"), F.col("n_children").alias("k_"))
    up = ["depth", "p1", "p2"]
    out = salted_join(out, parents.drop("k_"), up, hot_keys(parents.where("k_ > 0"), up, "k_"), "d1", "left")
    return out.select(
        F.col("m").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        (F.col("qs") - F.col("q") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct beginning of conversations: the first d turns (role and text), from the empty one on.

    Returns the smallest conversation with it (conv_id), depth d, the parent's conv_id (null for the root), n_convs,
    n_children, n_leaves (nodes of its subtree without children), saved_tokens (over its subtree, the bytes of a node's
    last text for each member but one) and ends_sha256 (of the ids, ascending, of the conversations that end there).

    Turns go by number, null first; turns that share a number go by a hash of role and text. A null role or text is
    empty. Rows without a conversation are left out; ids are whole numbers. Repeated rows are turns of their own. An
    empty table gives no nodes. Turns and nodes are known by 128 bits. A conversation of any length is spread over
    tasks in stretches.
    """
    placed = in_order(turn_keys(turns, conv_col, turn_col, role_col, text_col))
    return trie_nodes(placed, placed.select("c").distinct())
