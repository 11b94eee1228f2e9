"""Minimax contiguous partition of documents into shards of near equal size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

UNIT_BITS = 16
"""Groups are ordered by hash; 2**16 hash ranges are the atomic units, so what the driver sees is bounded."""

HOT_PARTS = 1024
"""A unit with more than 1/1024 of all rows is numbered in several parts."""


def _reach(prefix: np.ndarray, start: int, capacity: int) -> int:
    """The furthest end of a run of units from ``start`` that holds at most ``capacity`` bytes."""
    return int(np.searchsorted(prefix, prefix[start] + capacity, "right")) - 1


def _feasible(prefix: np.ndarray, shards: int, capacity: int) -> bool:
    at = 0
    for _ in range(shards):
        at = _reach(prefix, at, capacity)
        if at == len(prefix) - 1:
            return True
    return False


def minimax_cuts(sizes, shards: int) -> tuple[list[int], int]:
    """Ends of ``shards`` contiguous runs over ordered ``sizes``, and the smallest feasible capacity.

    The capacity is found by binary search with a greedy check. Every run keeps to it; within it each cut
    goes nearest to an equal share of what remains, so that the last runs are not left small.
    """
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    n, total = len(prefix) - 1, int(prefix[-1])
    low = max(int(max(sizes, default=0)), -(-total // shards))
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _feasible(prefix, shards, mid) else (mid + 1, high)
    earliest = [n]
    for _ in range(shards):
        earliest.append(int(np.searchsorted(prefix, prefix[earliest[-1]] - low, "left")))
    ends, at = [], 0
    for k in range(shards):
        left = shards - 1 - k
        first, last = max(at, earliest[left]), _reach(prefix, at, low)
        want = prefix[at] + (total - prefix[at]) / (left + 1)
        near = int(np.searchsorted(prefix, want, "left"))
        if near > 0 and (near > n or want - prefix[near - 1] <= prefix[near] - want):
            near -= 1
        at = min(max(near, first), last)
        ends.append(at)
    return ends, low


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row of ``docs`` into one of ``n_shards`` shards of near equal bytes; equal texts stay together.

    Groups of equal texts are ordered by the hash of the text. The atomic units are 2**16 ranges of that
    order, which never split a group; their sizes are cut by :func:`minimax_cuts`. Returns the id, n_bytes
    (UTF-8 bytes plus 16), text_crc32, shard and slot (0, 1, ... in each shard). A null text counts as empty.
    Repeated rows each get a slot of their own; null ids come first in their unit; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 16).cast("long").alias("n_bytes"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - UNIT_BITS).cast("int").alias("unit"),
        ),
        "rows",
    )
    stats = materialise(
        rows.groupBy("unit").agg(F.sum("n_bytes").alias("unit_bytes"), F.count(F.lit(1)).alias("unit_rows")), "units"
    )
    found = sorted((r.unit, r.unit_bytes, r.unit_rows) for r in stats.collect())  # 65,536 rows at most
    ends, _ = minimax_cuts([x[1] for x in found], n_shards)
    total_rows = max(1, sum(x[2] for x in found))
    firsts = [found[e][0] if e < len(found) else 1 << UNIT_BITS for e in ends[:-1]]
    shard = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= F.col("unit"))) if firsts else F.lit(0)
    before = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    units = stats.select("unit", "unit_rows", shard.cast("int").alias("shard")).select(
        "unit",
        "shard",
        F.coalesce(F.sum("unit_rows").over(before), F.lit(0)).alias("unit_base"),
        F.ceil(F.col("unit_rows") * F.lit(HOT_PARTS) / F.lit(total_rows)).alias("parts"),
    )
    placed = rows.join(F.broadcast(units), "unit").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0))
    )
    earlier = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.where("parts > 1")
        .groupBy("unit", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("unit", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    )  # 2 * HOT_PARTS rows at most
    inside = Window.partitionBy("unit", "part").orderBy("id", "n_bytes", "text_crc32")
    return placed.join(F.broadcast(parts), ["unit", "part"], "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        "text_crc32",
        "shard",
        (F.col("unit_base") + F.coalesce("part_base", F.lit(0)) + F.row_number().over(inside) - 1).alias("slot"),
    )
