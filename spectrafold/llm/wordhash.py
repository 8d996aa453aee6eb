"""Vectorised word and shingle hashing for Arrow batches.

Words are maximal runs of characters other than space, tab, LF, VT, FF and CR,
after lower-casing A-Z. UTF-8 bytes are hashed, so nothing is decoded. All
functions work on one bounded block of texts with numpy; Spark deals the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Blocks of whole texts hold about so many bytes; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, key: str, n: int) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1024)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        have = _powers[key] = np.cumprod(table, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (a bijection with good avalanche)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) runs of texts of about `limit` bytes together; each text lies whole in one run."""
    first = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Word hashes of a block of texts.

    hashes: uint64 of every word, in order; offsets: words of text i are
    hashes[offsets[i]:offsets[i + 1]]; start, end: byte positions in `data`.
    """

    def __init__(self, texts: list[bytes | None]):
        self.data = data = b" ".join([t or b"" for t in texts]) + b" "
        raw = np.frombuffer(data, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        text_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t or b"") + 1 for t in texts], out=text_start[1:])
        self.text_start = text_start
        self.offsets = np.searchsorted(self.start, text_start)
        value = _BYTE_VALUE[_LOWER[raw]] * _power_table(_MULT, "up", len(raw))
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value, out=prefix[1:])
        down = _power_table(_MULT_INV, "down", len(raw))
        self.hashes = mix((prefix[self.end] - prefix[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash for every run of `width` words, of one word sequence."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _STEP[0]
    for k in range(1, width):
        total = total + words[k : k + n] * _STEP[k]
    return mix(total)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `width` make one shingle, none make none."""
    for first, last in blocks(texts):
        block = Words(texts[first:last])
        every = shingle_hashes(block.hashes, width)
        for i in range(last - first):
            a, b = block.offsets[i], block.offsets[i + 1]
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                short = block.hashes[a:b] * _STEP[: b - a]
                yield mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
