"""Benchmark decontamination (operator 3).

For every benchmark item a window of the item's number of words slides over
each text word by word. A window's SimHash adds, bit by bit, the votes of its
five-word shingles, each with its number of occurrences as weight, from running
sums. A multi-index over the items' fingerprints (eight blocks of eight bits,
each looked up with up to two bits changed) finds every fingerprint within
RADIUS bits: of 23 differing bits at least one block has two or fewer. The
candidates are then verified by the exact weighted Jaccard similarity of window
and item, sum of least over sum of greatest counts, which must reach 0.75.

Windows that hold too few shingles of any item for that similarity are left
out beforehand; that bound is exact and loses nothing.

Scale: a map over the scan with no shuffle; only texts go to Python, only what
is found comes back. Items are taken in blocks of about ITEM_BYTES, each
broadcast; a larger benchmark makes more passes, not larger ones, and each task
holds one block. Blocks of texts and of candidates are bounded; only a longer
text takes more, in proportion.

Null, empty and blank items and texts match nothing. Items of fewer than five
words count as one shingle, the whole sequence, and match where it stands word
for word. A text shorter than the item is one window. Every row of items counts
by itself, also with an id or a text that another has; repeated rows give their
rows again. Ids may be of any type. Extra columns are dropped by `contaminated`
and kept, under any name, by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .shared import array_parts, unused

WIDTH = 5
SIMILARITY = 0.75
BLOCKS = 8
RADIUS = 23
ITEM_BYTES = 16 << 20
#: (window, item) places that the multi-index gives at once, about.
CANDIDATES = 1 << 20


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Shingle hashes of a sequence whose window is n words wide."""
    return wordhash.shingle_hashes(words, min(WIDTH, max(n, 1)))


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` shingles at these places: uint64 each."""
    first = int(starts.min())
    part = shingles[first : int(starts.max()) + size]
    votes = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
    running = np.zeros((len(part) + 1, 64), np.int32)
    np.cumsum(votes, axis=0, dtype=np.int32, out=running[1:])
    at = starts - first
    bits = 2 * (running[at + size] - running[at]) >= size
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


_NEAR = [[v ^ x for x in range(256) if x.bit_count() <= RADIUS // BLOCKS] for v in range(256)]


@dataclass
class Sized:
    """Items of one number of words: ids, fingerprints, counted shingles, and the multi-index."""

    words: int
    ids: list = field(default_factory=list)
    prints: list[int] = field(default_factory=list)
    counted: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: For each block and value of its byte, the items within reach: places in `near` from `offset`.
    offset: np.ndarray | None = None
    near: np.ndarray | None = None

    @property
    def size(self) -> int:
        return max(1, self.words - WIDTH + 1) if self.words >= WIDTH else 1

    def close(self) -> None:
        lists: list[list[int]] = [[] for _ in range(BLOCKS * 256)]
        for k, p in enumerate(self.prints):
            for block in range(BLOCKS):
                for value in _NEAR[(p >> (8 * block)) & 255]:
                    lists[256 * block + value].append(k)
        self.offset = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        self.near = np.array([k for x in lists for k in x], np.int64)

    def candidates(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, items) of every fingerprint within RADIUS bits, some windows at a time."""
        each = max(1, CANDIDATES // (BLOCKS * len(self.ids)))
        prints = np.array(self.prints, np.uint64)
        for at in range(0, len(found), each):
            some = found[at : at + each]
            value = some.astype("<u8").view(np.uint8).reshape(len(some), 8).astype(np.int64) + 256 * np.arange(BLOCKS)
            begin, many = self.offset[value].ravel(), (self.offset[value + 1] - self.offset[value]).ravel()
            window = np.repeat(np.repeat(np.arange(len(some)), BLOCKS), many)
            place = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
            window, item = np.divmod(np.unique(window * len(self.ids) + self.near[place]), len(self.ids))
            near = np.bitwise_count(some[window] ^ prints[item]) <= RADIUS
            yield at + window[near], item[near]


def counted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two counted bags of shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


@dataclass
class Index:
    """Items by their number of words, and all their shingles."""

    sized: list[Sized]
    #: Shingles of items of five words or more, and of shorter ones by their width.
    known: dict[int, np.ndarray]

    @classmethod
    def of(cls, items: list[tuple]) -> Index:
        by_words: dict[int, Sized] = {}
        known: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            words = wordhash.Words([(text or "").encode()]).hashes
            n = len(words)
            if not n:
                continue
            shingles = _shingles(words, n)
            own = by_words.setdefault(n, Sized(n))
            own.ids.append(item_id)
            own.prints.append(int(fingerprints(shingles, np.array([0]), len(shingles))[0]))
            own.counted.append(counted(shingles))
            known.setdefault(min(n, WIDTH), []).append(shingles)
        for own in by_words.values():
            own.close()
        return cls([by_words[n] for n in sorted(by_words)], {w: np.unique(np.concatenate(x)) for w, x in known.items()})

    def matches(self, words: np.ndarray) -> list[tuple]:
        """Of one text's words: (item id, similarity, first word, windows) for each item row that stands there."""
        out: list[tuple] = []
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, known in self.known.items():
            shingles = wordhash.shingle_hashes(words, width)
            if not len(shingles):
                continue
            at = np.searchsorted(known, shingles)
            at[at == len(known)] = 0
            hit = known[at] == shingles
            if hit.any():
                sums[width] = shingles, np.concatenate(([0], np.cumsum(hit)))
        for own in self.sized if sums else ():
            width = min(own.words, WIDTH)
            if width not in sums:
                continue
            shingles, running = sums[width]
            size = min(own.size, len(shingles))
            # similarity >= s needs an overlap of s / (1 + s) of both sizes together.
            least = SIMILARITY / (1 + SIMILARITY) * (size + own.size)
            starts = np.flatnonzero(running[size:] - running[:-size] >= least - 1e-9)
            if not len(starts):
                continue
            best: dict[int, list] = {}
            for window, item in own.candidates(fingerprints(shingles, starts, size)):
                bags: dict[int, tuple] = {}
                for w, k in zip(window.tolist(), item.tolist(), strict=True):
                    start = int(starts[w])
                    if w not in bags:
                        bags[w] = counted(shingles[start : start + size])
                    s = similarity(bags[w], own.counted[k])
                    if s >= SIMILARITY:
                        of_item = best.setdefault(k, [0.0, 0, 0])
                        of_item[2] += 1
                        if s > of_item[0]:
                            of_item[:2] = s, start
            out.extend((own.ids[k], *found) for k, found in best.items())
        return out


def _blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of items; a block is what one broadcast may hold."""
    rows = items.select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = 1 + int(total) // ITEM_BYTES
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield Index.of([(r["item_id"], r["text"]) for r in part])


def _matches(texts: list[bytes | None], index: Index) -> Iterator[list[tuple]]:
    for first, last in wordhash.blocks(texts):
        block = wordhash.Words(texts[first:last])
        for k in range(last - first):
            yield index.matches(block.hashes[block.offsets[k] : block.offsets[k + 1]])


def find(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "match") -> DataFrame:
    """A row of docs for each item that stands in the text, with `out`: struct<item_id, similarity of the best window, first_word of it, n_windows>."""
    docs = docs.drop(out)
    id_type = items.select("item_id").limit(0).toArrow().schema.field(0).type
    kind = f"struct<item_id:{items.schema['item_id'].dataType.simpleString()},similarity:double,first_word:bigint,n_windows:bigint>"
    fields = {"item_id": id_type, "similarity": pa.float64(), "first_word": pa.int64(), "n_windows": pa.int64()}

    def of_block(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by ITEM_BYTES

        @F.arrow_udf(f"array<{kind}>")
        def matches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in array_parts(texts):
                found = list(_matches(part.to_pylist(), shared.value))
                flat = [m for row in found for m in row]
                columns = [pa.array([m[k] for m in flat], t) for k, t in enumerate(fields.values())]
                edges = np.concatenate(([0], np.cumsum([len(row) for row in found]))).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(columns, list(fields)))

        return docs.withColumn(out, F.explode(matches(F.col(text).cast("binary"))))

    return reduce(DataFrame.unionAll, map(of_block, _blocks(items)))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows in whose text a benchmark item stands."""

    def clean(index: Index) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by ITEM_BYTES

        @F.arrow_udf("boolean")
        def none_found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in array_parts(texts):
                yield pa.array([not row for row in _matches(part.to_pylist(), shared.value)], pa.bool_())

        return none_found(F.col(text).cast("binary"))

    # One index at a time on the driver: what stays of it is the broadcast.
    tests = [clean(index) for index in _blocks(items)]
    if len(tests) == 1:
        return docs.where(tests[0])
    # A task holds one block of items: each block names the texts that hold one of its items.
    (name,) = unused(docs.columns, "name")
    texts = docs.select(F.md5(F.col(text).cast("binary")).alias(name), F.col(text))
    found = reduce(DataFrame.unionAll, [texts.where(~test).select(name) for test in tests]).distinct()
    return docs.withColumn(name, F.md5(F.col(text).cast("binary"))).join(found, name, "left_anti").select(*docs.columns)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digest of operator 3: a row for each document and item that stands in it: doc_id, item_id, similarity, first_word, n_windows."""
    found = find(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "match.item_id", "match.similarity", "match.first_word", "match.n_windows")
