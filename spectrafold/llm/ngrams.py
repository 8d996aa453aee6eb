"""Hashed character n-grams of one text, with numpy, for models that are read inside Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(codes: np.ndarray, width: int, bits: int) -> np.ndarray:
    """A bin, 0 to 2^bits - 1, for every run of `width` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = codes[:n] * _STEP[0]
    for k in range(1, width):
        total = total + codes[k : k + n] * _STEP[k]
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * width)
    return total >> np.uint32(32 - bits)
