"""A set of 64-bit keys as a bit array of bounded size, for pruning inside tasks.

A key of the set is always found; another one may be found too, so whoever
prunes by it must test what is left. The array has about 16 bits a key and
never more than MOST_BITS, however many keys there are: what is broadcast stays
bounded, only more is let through. Bits are set by a grouped aggregation; the
driver gets the words of the finished array, not the keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
LEAST_BITS = 1 << 16
#: 32 MB.
MOST_BITS = 1 << 28


class KeyFilter:
    """has(keys): for each unsigned 64-bit key, whether it may be of the set."""

    def __init__(self, words: np.ndarray):
        self._words, self._mask = words, np.uint64(64 * len(words) - 1)

    @classmethod
    def of(cls, keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> KeyFilter:
        """keys: a table that is cheap to read twice."""
        bits = LEAST_BITS
        many = keys.count()
        while bits < min(BITS_A_KEY * many, most_bits):
            bits *= 2
        place = F.col(column).bitwiseAND(F.lit(bits - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        found = keys.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & self._mask
        return (self._words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
