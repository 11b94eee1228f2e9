"""A bit map of 64-bit hashes, of bounded size, that tells tasks which rows can be left out before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAP_BITS = 26
"""A map has ``2 ** MAP_BITS`` bits at most (8 MB), however many keys there are; then more rows pass, but none is lost."""
BITS_A_KEY = 256


class BitMap:
    """Two slots for every hash, from its first and its last bits: one with an empty slot is not among the keys."""

    def __init__(self, bits: int, at: np.ndarray, values: np.ndarray) -> None:
        self.bits = bits
        self.map = np.zeros(1 << (bits - 6), np.uint64)
        self.map[at] = values

    def _set(self, slot: np.ndarray) -> np.ndarray:
        return ((self.map[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        """For each hash (unsigned) whether it may be among the keys."""
        out = self._set(keys >> np.uint64(64 - self.bits))
        out[out] = self._set(keys[out] & np.uint64((1 << self.bits) - 1))
        return out


def bit_map(keys: DataFrame, column: str, count: int) -> BitMap:
    """The map of a column of well-mixed hashes; it comes to the driver in words of 64 bits."""
    bits = min(MAP_BITS, max(16, (BITS_A_KEY * count).bit_length()))
    slots = F.explode(F.array(F.shiftrightunsigned(column, 64 - bits), F.col(column).bitwiseAND((1 << bits) - 1)))
    words = keys.select(slots.alias("slot")).select(F.shiftrightunsigned("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    return BitMap(bits, found["w"].to_numpy(np.int64), found["b"].to_numpy(np.int64).view(np.uint64))
