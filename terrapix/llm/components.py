"""Connected components of an edge table by alternating large-star and small-star rounds, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour on one side of a node with the least node of its neighbourhood.

    ``edges`` has (u, v) with u > v. Large: each node's greater neighbours go to the least one; small: the
    smaller neighbours and the node itself do. The minimum is aggregated before it is joined back, so that a
    node with very many links is neither gathered in one group nor in one array.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("n"), F.least("u", "m").alias("m")
    )
    near = both if not large else both.where("v > u")
    moved = near.join(least, near["u"] == least["n"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    """An order-free digest of an edge table."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("v", "u")),
        ).first()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels (node, root) of every node that has an edge; root is the least node of its component.

    ``edges`` has two integer columns, in any order, with repeats and loops allowed; rows with a null are no
    edges. An empty table gives an empty one. Each round is written to the shared folder, so a lost executor
    never replays earlier rounds. Raises if ``max_rounds`` rounds (2**30 hops and more) do not settle it.
    """
    a, b = edges.columns[:2]
    e = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct(),
        "edges",
    )
    before = _state(e)
    for _ in range(max_rounds if before[0] else 0):
        e = materialise(_star(_star(e, True), False), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
