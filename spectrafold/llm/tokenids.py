"""Token-id files with constant-time keyed access (operator 2).

`write_ids` encodes whole texts with the tokenizers library, appends an end id
to each document and writes the ids in ascending key order into shard files.
A shard file holds, after a JSON header: the bits and ranks of a minimal
perfect hash over its keys, per hash slot a stored fingerprint of the key, the
first document and the number of documents with the key, then the keys, the
offset of every document and the raw ids (little-endian, two bytes each where
the vocabulary fits, else four). A lookup hashes the key once for each of a few
bit levels, compares the fingerprint and reads one run of ids.

The hash is a cascade of collision bitmaps: a level keeps the keys that are
alone at their place, the others go down a level; a key's slot is the rank of
its bit among all set bits.

Scale: texts are range-partitioned by key once and sorted; a task writes its
range as shards of a bounded number of ids, under a name that a repeated task
writes again with the same content, by a rename. Only the manifest, one row a
shard, is summed in order. Files are read back with Spark's binaryFile source.
Files are written by pyarrow's file systems, which take file:, hdfs: and s3: paths.

Null texts are empty (the end id alone); null keys come first and are reached
by their place in the header, not by the hash; equal keys follow each other by
text and share a slot; an empty table gives no file and no rows; extra columns
are dropped.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_pattern
from .pieces import Pieces
from .shared import parts, shared_path
from .wordhash import mix

END_ID = 0
#: Ids of a shard file; one longer document makes a shard of its own.
SHARD_IDS = 4 << 20
MAGIC = b"SFTOKID1"
#: Places of a level for each key that comes to it.
GAMMA = 1.5
_ORDER = ("bits", "ranks", "prints", "first", "count", "keys", "offsets", "ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Matches of a generation of the cache: encoding one again costs more here than in operator 6, and no other stage shares the worker.
CACHE = 300_000


#: A byte that no UTF-8 text holds.
_BETWEEN = 0xFF


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Tokens:
    """encode(texts): bytes of the ids of each text by the tokenizers library, as little-endian unsigned integers of `width` bytes.

    With `added`, added tokens of the tokenizer's file are recognised, as the library does by default: a text that holds one
    is encoded whole. All other texts go through the cache of pattern matches, to the same ids.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added
        tokens = self._tokenizer.get_added_tokens_decoder().values() if added else ()
        self._added = re.compile("|".join(re.escape(t.content) for t in tokens)) if tokens else None
        # A normalizer can make an added token of other characters.
        self._whole = added and self._tokenizer.normalizer is not None
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._code = np.dtype(f"<u{self.width}")
        self._pieces = Pieces(pattern, self._new, self._code, CACHE)
        # The model alone, for matches that are cut already: its input is the bytes in their alphabet.
        self._model = Tokenizer(self._tokenizer.model) if _is_byte_level(json.loads(self._tokenizer.to_str())) else None
        if self._model is None:
            return
        # Spark's workers share the cores already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        alphabet = byte_alphabet() | {_BETWEEN: " "}
        self._written = np.array([ord(alphabet[b]) for b in range(256)], "<u2")
        vocab = self._model.get_vocab()
        self._size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, n in vocab.items():
            self._size[n] = len(token)

    def _whole_text(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self._code).tobytes()

    def _new(self, matches: list[bytes]) -> list[bytes]:
        if self._model is None:
            return [self._whole_text(m.decode()) for m in matches]
        out: list[bytes] = []
        for at in range(0, len(matches), 4096):
            raw = bytes([_BETWEEN]).join(matches[at : at + 4096])
            words = self._written[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le").split(" ")
            # The fast form gives ids alone; tokens are told apart by their bytes.
            ids = np.array(self._model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, self._code)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            edges = [0, *(self.width * np.searchsorted(np.cumsum(self._size[ids]), ends, side="right")).tolist()]
            flat = ids.tobytes()
            out.extend(flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        if self._added is None and not self._whole:
            yield from self._pieces.encode(texts)
            return
        whole = [bool(t) and (self._whole or self._added.search(t) is not None) for t in texts]
        rest = self._pieces.encode([None if w else t for t, w in zip(texts, whole, strict=True)])
        for t, w, ids in zip(texts, whole, rest, strict=True):
            yield self._whole_text(t) if w else ids


def _is_byte_level(parts: dict) -> bool:
    """Whether a tokenizer's file only cuts a text, writes its bytes in the alphabet and applies a model to each match, whose tokens together are those bytes."""
    cut, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or not model["vocab"].keys() >= set(byte_alphabet().values()):
        return False
    return parts.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


@lru_cache(maxsize=2)
def tokens(path: str, pattern: str, added: bool = False) -> Tokens:
    return Tokens(path, pattern, added)


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def key_print(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0xD1342543DE82EF95 % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: slots() gives 0 .. n - 1, each to one of them."""

    def __init__(self, levels: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.levels, self.bits, self.ranks = levels, bits, ranks

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, words = [], [np.zeros(0, np.uint64)]
        while len(hashes):
            size = max(64, -(-int(GAMMA * len(hashes)) // 64) * 64)
            place = _place(hashes, len(levels), size)
            count = np.bincount(place, minlength=size)
            words.append(np.packbits(count == 1, bitorder="little").view("<u8"))
            levels.append(size)
            hashes = hashes[count[place] != 1]
        bits = np.concatenate(words)
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)[:-1])).astype("<u4") if len(bits) else np.zeros(0, "<u4")
        return cls(levels, bits, ranks)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for a hash that meets no bit; one that is not of the set may also get a slot."""
        out, left, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.levels):
            place = _place(hashes[left], level, size)
            word, bit = base // 64 + place // 64, (place % 64).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return out


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard file of documents in key order, null keys first; ids: bytes of each document's ids, end id included."""
    nulls = sum(k is None for k in keys)
    own = np.array(keys[nulls:], np.int64)
    distinct, first, count = np.unique(own, return_index=True, return_counts=True)
    hashes = key_hash(distinct)
    index = PerfectHash.build(hashes)
    slot = index.slots(hashes)
    by_slot = np.argsort(slot)
    offsets = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) // width for x in ids], out=offsets[1:])
    parts = {
        "bits": index.bits.astype("<u8").tobytes(),
        "ranks": index.ranks.astype("<u4").tobytes(),
        "prints": key_print(hashes)[by_slot].astype("<u4").tobytes(),
        "first": (first[by_slot] + nulls).astype("<u4").tobytes(),
        "count": count[by_slot].astype("<u4").tobytes(),
        "keys": own.astype("<i8").tobytes(),
        "offsets": offsets.tobytes(),
        "ids": b"".join(ids),
    }
    head = {"width": width, "docs": len(ids), "nulls": nulls, "levels": index.levels, "bytes": [len(parts[p]) for p in _ORDER]}
    text = json.dumps(head).encode()
    return b"".join([MAGIC, len(text).to_bytes(4, "little"), text, *[parts[p] for p in _ORDER]])


class Shard:
    """A shard file in memory."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token-id shard")
        at = 12 + int.from_bytes(data[8:12], "little")
        self.head = head = json.loads(bytes(data[12:at]))
        kinds = {"bits": "<u8", "ranks": "<u4", "prints": "<u4", "first": "<u4", "count": "<u4", "keys": "<i8", "offsets": "<u8", "ids": f"<u{head['width']}"}
        part = {}
        for name, size in zip(_ORDER, head["bytes"], strict=True):
            kind = np.dtype(kinds[name])
            part[name] = np.frombuffer(data, kind, size // kind.itemsize, at)
            at += size
        self.index = PerfectHash(head["levels"], part["bits"], part["ranks"])
        self.prints, self.first, self.count, self.keys = part["prints"], part["first"], part["count"], part["keys"]
        self.offsets, self.ids, self.nulls = part["offsets"].astype(np.int64), part["ids"], head["nulls"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; number 0 where the key is not in the shard."""
        hashes = key_hash(keys)
        slot = self.index.slots(hashes)
        known = np.flatnonzero(slot >= 0)
        known = known[self.prints[slot[known]] == key_print(hashes[known])]
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], count[known] = self.first[slot[known]], self.count[slot[known]]
        # The fingerprint can agree by chance: the stored key decides.
        wrong = known[self.keys[first[known] - self.nulls] != keys[known]]
        count[wrong] = 0
        return first, count

    def document(self, n: int) -> np.ndarray:
        return self.ids[self.offsets[n] : self.offsets[n + 1]]


_MANIFEST = "part int, piece int, file string, docs bigint, ids bigint, first_key bigint, last_key bigint"


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, pattern: str | None = None, shard_ids: int = SHARD_IDS, added: bool = False) -> DataFrame:
    """Write the ids of docs below path, with `added` with ids of the tokenizer's added tokens; the manifest, one row a shard, is also kept there."""
    from_file, split = tokenizer or default_tokenizer(), pattern or default_pattern()
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own, part = tokens(from_file, split, added), TaskContext.get().partitionId()
        end = END_ID.to_bytes(own.width, "little")
        where, root = fs.FileSystem.from_uri(path)
        keys: list[int | None] = []
        ids: list[bytes] = []
        piece = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal piece, size
            name = f"part-{part:06d}-{piece:04d}.ids"
            where.create_dir(root, recursive=True)
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as out:
                out.write(pack(keys, ids, own.width))
            where.move(draft, f"{root}/{name}")
            given = [k for k in keys if k is not None]
            row = {"part": part, "piece": piece, "file": name, "docs": len(ids), "ids": size // own.width, "first_key": given[0] if given else None, "last_key": given[-1] if given else None}
            piece, size = piece + 1, 0
            keys.clear()
            ids.clear()
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in parts(batches):
            for k, x in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                if size and size + len(x) > shard_ids * own.width:
                    yield flush()
                keys.append(k)
                ids.append(x + end)
                size += len(ids[-1])
        if ids:
            yield flush()

    manifest = rows.mapInArrow(run, _MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(path).select("path", "content")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files, found by its key: key, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                first, count = shard.find(np.unique(shard.keys))
                docs = np.concatenate([np.arange(shard.nulls), *[np.arange(a, a + n) for a, n in zip(first.tolist(), count.tolist(), strict=True)]]).astype(np.int64)
                keys = [None if d < shard.nulls else int(shard.keys[d - shard.nulls]) for d in docs.tolist()]
                sums = [zlib.crc32(shard.document(d).astype("<u4").tobytes()) for d in docs.tolist()]
                begin = shard.offsets[docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py().rsplit("/", 1)[1]] * len(docs), pa.string()), pa.array(keys, pa.int64()), pa.array(begin, pa.int64()), pa.array(shard.offsets[docs + 1] - begin, pa.int64()), pa.array(sums, pa.int64())],
                    names=["file", "key", "begin", "n_tokens", "ids_crc32"],
                )

    found = _shards(spark, path).mapInArrow(run, "file string, key bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
    # One row a shard passes the window, not the documents.
    before = F.sum("ids").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest_of(spark, path).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return found.join(starts, "file").select("key", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """key and ids (array) of the documents with these keys; only shards whose key range holds one of them are opened."""
    wanted = sorted(set(keys))
    near = F.exists(F.array(*[F.lit(k).cast("bigint") for k in wanted]), lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key")))
    files = [r["file"] for r in manifest_of(spark, path).where(near).select("file").collect()]  # at most a few for each key asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                shard = Shard(content.as_buffer())
                first, count = shard.find(np.array(wanted, np.int64))
                hits = [(k, d) for k, a, n in zip(wanted, first.tolist(), count.tolist(), strict=True) for d in range(a, a + n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in hits], pa.int64()), pa.array([shard.document(d).astype(np.int64) for _, d in hits], pa.list_(pa.int64()))], names=["key", "ids"]
                )

    schema = "key bigint, ids array<bigint>"
    if not files or not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load([f"{path}/{f}" for f in files]).select("path", "content").mapInArrow(run, schema)


def encode_and_read_back(docs: DataFrame) -> DataFrame:
    """Digest of operator 2: write all documents' ids to the shared folder, read the files, one row a document."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    if write_ids(docs, path, added=True).isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_ids(spark, path).withColumnRenamed("key", "doc_id")
