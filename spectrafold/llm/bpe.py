"""Byte-level BPE encoding and decoding (operator 6).

Corpus-level merge replay: the corpus is dealt in blocks; of a block, every
distinct pattern match that the worker does not know yet joins one array of
byte tokens. An inverted index from the rank of a token pair to its positions
in that array is built once; then every merge that occurs is applied in rank
order, at all its positions, and only the two neighbours of a merged position
are looked up again. A merge that a later one makes possible at a lower rank is
taken at once, leftmost first within a match, as the rank rules say.

Matches do not wait for each other: the index is one sorted array of ranks and
positions, and a pass over it takes the first position of every match at once.
Matches of more than LONG bytes would need too many passes; their index is a
heap of ranks with a heap of positions for each, taken one by one.

Scale: a map over the scan, no shuffle. A worker holds the ranks (a fixed
table), a bounded cache and one block; only a text that is longer than a block
takes more memory, in proportion to itself. The matches of a block do not
depend on other blocks, so a lost task repeats alone.

Null texts count as empty: no ids, the hash of no bytes. Repeated rows give the
same row again, extra columns are dropped, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import Pieces
from .shared import parts, schema_with

_BITS = 20
#: Bits of a position in an entry of the index, below those of the rank.
_PLACE = 40
#: Merges of matches of more bytes are taken one by one.
LONG = 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Ranks:
    """A rank file: token bytes and their ids, which are also the ranks of the merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {i: t for t, i in self.ids.items()}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.merge: dict[int, int] = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.merge[left << _BITS | right] = rank
        self.pairs = np.array(sorted(self.merge), np.int64)
        self.merged = np.array([self.merge[p] for p in self.pairs.tolist()], np.int64)
        self.first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.merge.get(int(self.byte[a]) << _BITS | int(self.byte[b]), -1)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of tokens, -1 where there is none."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int64)
        wanted = left << _BITS | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], -1)


def replay(ranks: Ranks, words: list[bytes]) -> list[bytes]:
    """Ids of each word, as little-endian unsigned 32-bit integers, by replaying the merges over all words together."""
    short = [len(w) <= LONG for w in words]
    together = iter(_replay_short(ranks, [w for w, s in zip(words, short, strict=True) if s]))
    rest = iter(_replay_long(ranks, [w for w, s in zip(words, short, strict=True) if not s]))
    return [next(together) if s else next(rest) for s in short]


def _bytes_of(token: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Ids of the words that end at these places, of an array of tokens in which those that were merged away are negative."""
    alive = token >= 0
    counts = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))] * 4
    flat = token[alive].astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)]


def _replay_short(ranks: Ranks, words: list[bytes]) -> list[bytes]:
    """The same for words of a few merges each: every pass applies the next merge of each word."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(words), np.uint8)
    token = ranks.byte[raw]
    n = len(token)
    word = np.repeat(np.arange(len(words)), sizes)
    inner = word[1:] == word[:-1]
    following, before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    following[:-1][inner] = np.flatnonzero(inner) + 1
    before[1:][inner] = np.flatnonzero(inner)
    # Rank of the pair that begins at a position, -1 if it is none that merges.
    rank = np.full(n, -1, np.int64)
    rank[:-1][inner] = ranks.first[raw[:-1], raw[1:]][inner]
    at = np.flatnonzero(rank >= 0)
    # The inverted index: rank of a pair and position, in this order.
    index = np.sort(rank[at] << _PLACE | at)
    first = np.zeros(len(words), np.int64)
    while len(index):
        at = index & ((1 << _PLACE) - 1)
        own = word[at]
        # Read from its end, so that the first entry of a word is what remains.
        first[own[::-1]] = at[::-1]
        at = at[first[own] == at]
        lowest, nxt, prior = rank[at], following[at], before[at]
        after = following[nxt]
        token[at], token[nxt], rank[nxt] = lowest, -1, -1
        following[at] = after
        more = after >= 0
        before[after[more]] = at[more]
        rank[at] = -1
        rank[at[more]] = ranks.of_pairs(lowest[more], token[after[more]])
        more = prior >= 0
        prior = prior[more]
        rank[prior] = ranks.of_pairs(token[prior], lowest[more])
        touched = np.concatenate((at, prior))
        touched = touched[rank[touched] >= 0]
        index = index[rank[index & ((1 << _PLACE) - 1)] == index >> _PLACE]
        index = np.sort(np.concatenate((index, rank[touched] << _PLACE | touched)))
    return _bytes_of(token, ends)


def _replay_long(ranks: Ranks, words: list[bytes]) -> list[bytes]:
    """The same for words of any length: merges are taken one by one, in rank order over all words."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(words), np.uint8)
    token = ranks.byte[raw].tolist()
    n = len(token)
    last = np.zeros(n, bool)
    last[ends[sizes > 0] - 1] = True
    here = np.flatnonzero(~last)
    here = here[here < n - 1]
    rank = ranks.first[raw[here], raw[here + 1]]
    here, rank = here[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    here, rank = here[order], rank[order]
    starts = np.flatnonzero(np.diff(rank, prepend=-1))
    # The inverted index: rank of a pair to a heap of its positions (rising lists are heaps).
    index = {int(rank[a]): list(map(int, block)) for a, block in zip(starts, np.split(here, starts[1:]), strict=False)}
    following = np.where(last, -1, np.arange(1, n + 1)).tolist()
    before = np.where(np.concatenate(([True], last[:-1])), -1, np.arange(-1, n - 1)).tolist() if n else []
    queue, merge = list(index), ranks.merge
    heapify(queue)
    while queue:
        lowest = queue[0]
        places = index[lowest]
        if not places:
            heappop(queue)
            del index[lowest]
            continue
        at = heappop(places)
        left, nxt = token[at], following[at]
        if left < 0 or nxt < 0 or merge.get(left << _BITS | token[nxt]) != lowest:
            continue  # a merge before has used one of the two
        token[at], token[nxt] = lowest, -1
        after = following[at] = following[nxt]
        if after >= 0:
            before[after] = at
            touched = merge.get(lowest << _BITS | token[after])
            if touched is not None:
                if touched in index:
                    heappush(index[touched], at)
                else:
                    index[touched] = [at]
                    heappush(queue, touched)
        prior = before[at]
        if prior >= 0:
            touched = merge.get(token[prior] << _BITS | lowest)
            if touched is not None:
                if touched in index:
                    heappush(index[touched], prior)
                else:
                    index[touched] = [prior]
                    heappush(queue, touched)
    return _bytes_of(np.array(token, np.int64), ends)


class Encoder:
    """encode(texts) gives the bytes of the ids of each text; decode(ids) the text's bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = Ranks(ranks_path)
        self._pieces = Pieces(pattern, self._new, np.dtype("<u4"))

    def _new(self, words: list[bytes]) -> list[bytes]:
        # A match that is a token itself is that token, whatever the merges would make of it.
        known = [self.ranks.ids.get(w) for w in words]
        rest = iter(replay(self.ranks, [w for w, k in zip(words, known, strict=True) if k is None]))
        return [next(rest) if k is None else k.to_bytes(4, "little") for k in known]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        return self._pieces.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return self.ranks.decode(ids)


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The worker's encoder; Spark's workers live from task to task."""
    return Encoder(ranks_path, pattern)


def encode(docs: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """docs with a binary column `out`: the ids of the text as little-endian unsigned 32-bit integers."""
    path, split = ranks_path or default_ranks(), pattern or default_pattern()
    docs = docs.drop(out)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, split)
        for batch in parts(batches):
            ids = pa.array(list(own.encode(batch.column(place).to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema_with(docs, **{out: "binary"}))


def decode(rows: DataFrame, ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None, out: str = "decoded") -> DataFrame:
    """rows with a binary column `out`: the bytes that the ids stand for; null ids give null."""
    path, split = ranks_path or default_ranks(), pattern or default_pattern()
    rows = rows.drop(out)
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, split)
        for batch in parts(batches):
            raw = pa.array([None if x is None else own.decode(x) for x in batch.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema_with(rows, **{out: "binary"}))


def transcode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every document: encoded and decoded by one worker."""
    return _both_ways(docs, ranks_path, pattern, True)


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digest of encoding and decoding every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _both_ways(docs, ranks_path, pattern, False)


def _both_ways(docs: DataFrame, ranks_path: str | None, pattern: str | None, with_ids: bool) -> DataFrame:
    path, split = ranks_path or default_ranks(), pattern or default_pattern()
    docs = docs.select("doc_id", "text")
    names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, split)
        for batch in parts(batches):
            every = list(own.encode(batch.column(1).to_pylist()))
            columns = [batch.column(0), pa.array([len(ids) // 4 for ids in every], pa.int64())]
            if with_ids:
                columns.append(pa.array(every, pa.binary()))
            columns.append(pa.array([hashlib.sha256(ids).hexdigest() for ids in every], pa.string()))
            columns.append(pa.array([hashlib.sha256(own.decode(ids)).hexdigest() for ids in every], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "n_tokens": "bigint", "ids": "binary"}
    return docs.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
