"""Encoding of whole texts through a bounded cache of pattern matches, for byte-level BPE.

The splitting pattern cuts a text into matches that are encoded independently.
They repeat far more than texts, so each distinct one of a block is encoded
once and kept by the worker.

A block is cut, looked up and put together by numpy. A match of up to KEY bytes
is its own key, three 64-bit numbers; equal keys of a block meet by sorting
hashes of them, and the distinct ones are searched in a sorted table of hashes.
Keys are compared as a whole, so hashes that agree by chance cost an encoding
and no more. Longer matches are kept by themselves, up to LONG_BYTES of them.
Ids of all matches lie in one array, from which those of a block are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex

from . import wordhash

#: Matches of a generation of the cache; two generations are kept, what is used again moves to the younger one.
CACHE = 120_000

#: Encodes distinct pattern matches, given as UTF-8: little-endian bytes of the ids of each.
Encode = Callable[[list[bytes]], list[bytes]]

#: The pattern that is cut by numpy; others are cut by the regular expression.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)

#: Bytes of a match that is its own key; the last of the key's 24 bytes is their number.
KEY = 23
#: Bytes of longer matches that are kept.
LONG_BYTES = 4 << 20
_MASK = np.frombuffer(b"".join(b"\xff" * k + bytes(24 - k) for k in range(KEY + 1)), "<u8").reshape(-1, 3)

#: Matches of a block that are looked up together: a block is longer where one text is.
MATCHES = 1 << 18

#: Bytes of a block's texts, and of its matches: byte positions of begin and end; and the number of matches of each text.
Cut = tuple[bytes, np.ndarray, np.ndarray, np.ndarray]


def narrow_pattern(pattern: str, limit: int) -> re.Pattern | None:
    """The same pattern for texts of code points below a limit, with the classes of letters, numbers and white space written out; None if it has other classes."""
    classes = (r"\s", r"\p{L}", r"\p{N}")
    members = {c: "".join(re.escape(chr(x)) for x in range(limit) if regex.fullmatch(c, chr(x))) for c in classes}
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(members.values())}]").replace(r"\S", f"[^{members[classes[0]]}]")
    for c in classes:
        plain = plain.replace(c, f"[{members[c]}]")
    return None if re.search(r"\\[pPwWdDbB]", plain) else re.compile(plain)


def is_latin(text: str) -> bool:
    """Whether all code points are below 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """White space, letter, number or other, of every code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), _OTHER, np.uint8)
    for kind, members in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(members, every):
            out[m.start() : m.end()] = kind
    return out


def _byte_places(text: str, points: np.ndarray) -> np.ndarray:
    """Where the UTF-8 of each code point begins, and the end."""
    if text.isascii():
        return np.arange(len(points) + 1)
    width = np.ones(len(points), np.uint8)
    for limit in (0x80, 0x800, 0x10000):
        width += points >= limit
    return np.concatenate(([0], np.cumsum(width, dtype=np.int64)))


def cut_words(texts: list[str]) -> Cut:
    """The matches of WORDS: runs of one kind, moved by the rules on white space before a run and on contractions."""
    text = "".join(texts)
    raw, n = text.encode(), len(text)
    point = np.frombuffer(raw, np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    kind = _kinds()[point]
    edge, fresh = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    fresh[first] = fresh[n] = True
    edge |= fresh
    run = np.flatnonzero(edge)
    begin, end = run[:-1], run[1:]
    of, followed = kind[begin], ~fresh[end]
    # The last character of white space before a run stands alone; if it is a space, it belongs to that run.
    after = end[(of == _SPACE) & followed]
    edge[after - 1] = True
    edge[after[point[after - 1] == ord(" ")]] = False
    # An apostrophe that begins a match, and the letters of a contraction behind it.
    k = np.flatnonzero((of == _OTHER) & followed & (end - begin == 1) & (point[begin] == ord("'")))
    k = k[edge[begin[k]] & (of[np.minimum(k + 1, len(of) - 1)] == _LETTER)]
    at, stop = end[k], end[k + 1]
    one, two = point[at], np.where(at + 1 < stop, point[np.minimum(at + 1, n - 1)], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    edge[at[single | double]] = False
    edge[at[single] + 1] = True
    edge[at[double] + 2] = True
    place = np.flatnonzero(edge)
    many = np.diff(np.searchsorted(place, np.concatenate((first, [n]))))
    place = _byte_places(text, point)[place]
    return raw, place[:-1], place[1:], many


class _Table:
    """Keys of matches by number, their hashes in order, and ids: those of number k are ids[edge[k]:edge[k + 1]]."""

    def __init__(self, code: np.dtype):
        self.keys, self.hashes, self.numbers = np.zeros((0, 3), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.edge = np.zeros(0, code), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        number = self.numbers[np.minimum(np.searchsorted(self.hashes, hashes), len(self.numbers) - 1)]
        return np.where((self.keys[number] == keys).all(axis=1), number, -1)

    def add(self, hashes: np.ndarray, keys: np.ndarray, found: list[bytes]) -> None:
        at = np.searchsorted(self.hashes, hashes)
        self.numbers = np.insert(self.numbers, at, np.arange(len(self.keys), len(self.keys) + len(keys)))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.keys = np.concatenate((self.keys, keys))
        self.ids, self.edge = self.with_more(found)

    def with_more(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids and edge with further ones at their ends."""
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.ids.itemsize
        return np.concatenate((self.ids, np.frombuffer(b"".join(found), self.ids.dtype))), np.concatenate((self.edge, self.edge[-1] + np.cumsum(sizes)))


class Pieces:
    """encode(texts): for each text the bytes of its ids, which are numbers of the type `code`."""

    def __init__(self, pattern: str, encode: Encode, code: np.dtype, cache: int = CACHE):
        self._encode, self._limit, self._code = encode, cache, np.dtype(code)
        self._cut = cut_words if pattern == WORDS else self._cut_by_pattern
        self._find = regex.compile(pattern).finditer
        ascii, latin = narrow_pattern(pattern, 128), narrow_pattern(pattern, 256)
        self._find_ascii = ascii.finditer if ascii else self._find
        self._find_latin = latin.finditer if latin else self._find
        self._known, self._old = _Table(self._code), _Table(self._code)
        self._long: dict[bytes, bytes] = {}

    def _cut_by_pattern(self, texts: list[str]) -> Cut:
        spans = [[m.span() for m in (self._find_ascii if t.isascii() else self._find_latin if is_latin(t) else self._find)(t)] for t in texts]
        many = np.fromiter(map(len, spans), np.int64, len(spans))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text = "".join(texts)
        flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2) + np.repeat(np.cumsum(lengths) - lengths, many)[:, None]
        place = _byte_places(text, np.frombuffer(text.encode("utf-32-le"), "<u4"))[flat]
        return text.encode(), place[:, 0], place[:, 1], many

    def _kept(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers in the known table of matches of up to KEY bytes; new ones are encoded and put there."""
        window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw + bytes(24), np.uint8), 24)
        keys = window[start].view("<u8") & _MASK[size]
        keys[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        hashes = wordhash.mix(keys[:, 0] + wordhash.mix(keys[:, 1] + wordhash.mix(keys[:, 2])))
        order = np.argsort(hashes)
        keys, hashes = keys[order], hashes[order]
        begins = np.ones(len(keys), bool)
        begins[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        of, keys, hashes, order_of = np.cumsum(begins) - 1, keys[begins], hashes[begins], order[begins]
        number = self._known.find(hashes, keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._added(raw, start[order_of[new]], size[order_of[new]], hashes[new], keys[new])
        out = np.empty(len(start), np.int64)
        out[order] = number[of]
        return out

    def _added(self, raw: bytes, start: np.ndarray, size: np.ndarray, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of matches that are new to the known table: their ids come from the older one or are made."""
        known, old = self._known, self._old
        earlier = old.find(hashes, keys)
        rest = earlier < 0
        made = iter(self._encode([raw[a:b] for a, b in zip(start[rest].tolist(), (start + size)[rest].tolist(), strict=True)]))
        known.add(hashes, keys, [next(made) if k < 0 else old.ids[old.edge[k] : old.edge[k + 1]].tobytes() for k in earlier.tolist()])
        return np.arange(len(known.keys) - len(keys), len(known.keys))

    def _long_ones(self, matches: list[bytes]) -> list[bytes]:
        if sum(map(len, self._long)) > LONG_BYTES:
            self._long.clear()
        new = [m for m in matches if m not in self._long]
        self._long.update(zip(new, self._encode(new), strict=True))
        return [self._long[m] for m in matches]

    def _ids(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of matches one after the other, and the number of ids of each."""
        size = end - start
        short = size <= KEY
        place = np.empty(len(start), np.int64)
        place[short] = self._kept(raw, start[short], size[short])
        ids, edge = self._known.ids, self._known.edge
        if not short.all():
            long = [raw[a:b] for a, b in zip(start[~short].tolist(), end[~short].tolist(), strict=True)]
            number = {m: k for k, m in enumerate(dict.fromkeys(long), len(edge) - 1)}
            place[~short] = [number[m] for m in long]
            ids, edge = self._known.with_more(self._long_ones(list(number)))
        sizes = edge[place + 1] - edge[place]
        ends = np.cumsum(sizes)
        return ids[np.repeat(edge[place] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes(), sizes

    def _block(self, texts: list[str]) -> list[bytes]:
        raw, start, end, many = self._cut(texts)
        flat, sizes = [], [np.zeros(1, np.int64)]
        for at in range(0, len(start), MATCHES):
            if len(self._known.keys) > self._limit:
                self._old, self._known = self._known, _Table(self._code)
            ids, of = self._ids(raw, start[at : at + MATCHES], end[at : at + MATCHES])
            flat.append(ids)
            sizes.append(of)
        every, ends = b"".join(flat), np.cumsum(np.concatenate(sizes))
        edges = (self._code.itemsize * ends[np.concatenate(([0], np.cumsum(many)))]).tolist()
        return [every[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Null texts are empty."""
        texts = [t or "" for t in texts]
        for first, last in wordhash.blocks(texts):
            yield from self._block(texts[first:last])
