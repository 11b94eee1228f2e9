"""Sums along the orders of a table under many weights, without a copy of every row for every weight."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

PLACES = 1 << 22
"""Places (rows times weights) of a block, about: what one task holds."""
BUCKET = 1 << 20
"""Rows of one weight that one task puts into order, about."""
SAMPLE = 1 << 16
"""Rows from which the bounds of buckets are taken; they come to the driver and only tell how rows are dealt."""
LAST = np.iinfo(np.int64).max


def packed(ascending: np.ndarray) -> bytes:
    """Whole numbers as their differences, first all first bytes, then all second ones and so on: a shuffle's own
    compression shrinks the bytes that are alike."""
    return np.diff(ascending, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel().cumsum()


def codes(u: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of falling weighted sums of ``u``, equal for equal sums; NaN, then null, come last."""
    score = weights[0] * u[:, 0]
    for i in range(1, len(weights)):
        score = score + weights[i] * u[:, i]
    x = 0.0 - score
    x[np.isnan(x)] = np.nan  # one NaN, above infinity
    bits = x.view(np.int64)
    return np.where(known, bits ^ ((bits >> 63) & LAST), LAST)


def sums_along(df: DataFrame, weights: np.ndarray, columns: list[str], key: str, values: list[str], early: list[str]) -> DataFrame:
    """(weight, n, value sums) along the order of each of the ``weights`` (a row each): its weighted sum of ``columns``
    falling, then the key.

    A row at place k of n counts n - k + 1/2 times in ``late_<value>``, and k - 1/2 times in ``early_<value>`` for the values
    in ``early``; ``sum_<value>`` is the plain sum. Nulls are left out.

    Rows are cut once into blocks by ranges of the key. A block sends, for every weight and range of its order (bucket),
    only the sorted scores; a task puts those of a bucket into order, ties by block, and sends every block its places.
    The block adds up its rows by bucket, and buckets are shifted by the rows before and after them. A bucket's bounds
    have a score and a block, so that equal scores are dealt as well.
    """
    spark, m, names = df.sparkSession, len(weights), [f"u{i}" for i in range(len(columns))]
    held = [f"v{i}" for i in range(len(values))]
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(a) for a, c in zip([*names, *held], [*columns, *values], strict=True)])
    n = rows.count()
    blocks, buckets = max(1, math.ceil(n * m / PLACES)), max(1, math.ceil(n / BUCKET))
    rows = stored(rows.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), "blocks")
    bounds: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * m
    if buckets > 1:
        some = rows.where(F.pmod(F.xxhash64("key"), F.lit(n)) < SAMPLE).select("block", *names).limit(2 * SAMPLE)
        some = some.na.drop(subset=names).toPandas()
        u, block = some[names].to_numpy(np.float64), some["block"].to_numpy(np.int64)
        at = np.arange(1, buckets) * len(u) // buckets
        for i, w in enumerate(weights if len(u) else ()):
            code = codes(u, np.ones(len(u), bool), w)
            cut = np.lexsort((block, code))[at]
            bounds[i] = code[cut], block[cut]

    def sorted_block(t: pa.Table) -> tuple[pa.Table, int, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """A block by key, its number, and by weight: its order, the codes along it and the starts of its buckets."""
        t = t.take(pc.sort_indices(t["key"], null_placement="at_start"))
        known = np.logical_and.reduce([t[c].is_valid().to_numpy() for c in names])
        u, own = numbers(t, names), t["block"][0].as_py()

        def along() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            for i, w in enumerate(weights):
                code = codes(u, known, w)
                order = np.argsort(code, kind="stable")
                code, (value, block) = code[order], bounds[i]
                yield i, order, code, np.concatenate([[0], np.where(own < block, np.searchsorted(code, value, "right"), np.searchsorted(code, value, "left")), [len(code)]])

        return t, own, along()

    def numbers(t: pa.Table, of: list[str]) -> np.ndarray:
        """Columns with 0 for null."""
        return np.stack([pc.fill_null(t[c], 0.0).to_numpy() for c in of], 1)

    def ask(t: pa.Table) -> pa.Table:
        _, own, along = sorted_block(t)
        out = [(i, b, own, packed(code[a:z])) for i, _, code, cut in along for b, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["weight", "bucket", "block", "codes"])

    def answer(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t["block"]))
        lists = [unpacked(b.as_buffer()) for b in t["codes"]]
        code = np.concatenate(lists)
        place = np.empty(len(code), np.int64)
        place[np.argsort(code, kind="stable")] = np.arange(1, len(code) + 1)
        places = np.split(place, np.cumsum([len(x) for x in lists])[:-1])
        return t.select(["weight", "bucket", "block"]).append_column("size", pa.array([len(code)] * len(t), pa.int64())).append_column("places", pa.array(map(packed, places), pa.binary()))

    def add(t: pa.Table, s: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_arrays([pa.array([], k) for k in out_kinds], out_names)
        t, _, along = sorted_block(t)
        v = numbers(t, held)
        there = np.stack([t[c].is_valid().to_numpy() for c in held], 1)
        got = {(i, b): (size, places) for i, b, size, places in zip(*[s[c].to_pylist() for c in ("weight", "bucket", "size")], s["places"], strict=True)}
        out: list[tuple] = []
        for i, order, _, cut in along:
            for b, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                if z > a:
                    size, places = got[i, b]
                    own, place = v[order[a:z]], unpacked(places.as_buffer()) - 0.5
                    real = there[order[a:z]].any(0)
                    sums = own.sum(0), (size - place) @ own, place @ own[:, front]
                    mask = real, real, real[front]
                    out.append((i, b, z - a, *[float(x) if r else None for xs, rs in zip(sums, mask, strict=True) for x, r in zip(xs, rs, strict=True)]))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), out_kinds, strict=True)], out_names)

    front = [values.index(v) for v in early]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    sums = [*[f"sum_{v}" for v in values], *[f"late_{v}" for v in values], *[f"early_{v}" for v in early]]
    out_names, out_kinds = ["weight", "bucket", "rows", *sums], [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * len(sums)]
    asked = rows.groupBy("block").applyInArrow(ask, "weight int, bucket int, block int, codes binary")
    placed = asked.groupBy("weight", "bucket").applyInArrow(answer, "weight int, bucket int, block int, size long, places binary")
    added = rows.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(add, "weight int, bucket int, rows long, " + ", ".join(f"`{c}` double" for c in sums))
    added = added.groupBy("weight", "bucket").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums])
    every, upto = Window.partitionBy("weight"), Window.partitionBy("weight").orderBy("bucket")
    added = added.withColumns({"n": F.sum("rows").over(every), "upto_": F.sum("rows").over(upto)})
    shift = {"late": F.col("n") - F.col("upto_"), "early": F.col("upto_") - F.col("rows")}
    moved = lambda side, v: F.col(f"{side}_{v}") + F.when(shift[side] > 0, shift[side] * F.col(f"sum_{v}")).otherwise(0.0)
    totals = [F.sum(moved(side, v)).alias(f"{side}_{v}") for side, of in (("late", values), ("early", early)) for v in of]
    return added.groupBy("weight").agg(F.first("n").alias("n"), *[F.sum(f"sum_{v}").alias(f"sum_{v}") for v in values], *totals)
