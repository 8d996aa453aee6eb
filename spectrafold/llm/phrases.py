"""Phrase collocation mining (operator 12).

Texts are lower-cased (A-Z) and split at punctuation and line ends into pieces,
these into words. The corpus is kept vertically: for each block of texts of one
language, the distinct words with the sorted list of the positions of each.
Positions run on through the block and skip one at the end of a piece, so words
that follow each other have neighbouring positions.

Frequent phrases grow level by level. The occurrences of a phrase of k + 1 words
are those positions of a frequent phrase of k words whose next position is one of
a frequent phrase of k words too: position lists are merge-joined with the lists
of what follows. The length of a list is the phrase's frequency in the block; the
sum over all blocks is its exact frequency. Between levels, lengths of hashed
phrases are summed over all blocks, and blocks learn from a bit array of bounded
size what may be frequent. Hashes only prune: the last pass names phrases by
their words, and what it lets through is counted and tested by these.

Hashed phrases travel packed: their range is cut into parts, a task sums what
some blocks have and hands on a row for each part, and Spark groups by part.

A phrase is cut in two parts in every way; score = floor(10^6 a^2 / (l r)), the
lowest counts. A phrase is dropped if a longer frequent one that holds it
accounts for half of it or more.

Scale: texts are read once; later levels read the packed lists. Shuffled are a
row for each block and distinct word, 5 bytes as a rule for each hashed phrase of
frequent parts that some blocks have, and a row for each phrase that may be
frequent and task. The number of parts follows the corpus: none has more than
about PART of its phrases. Joins of
phrases to their parts meet hot words: the parts' side has one row a key, so
skewed keys can be split. Ranks come from a range partitioning over all phrases
and the sizes of its ranges; no task holds a language. Arithmetic is in decimals
of 38 digits: frequencies up to 5 * 10^15.

A null text is empty, a null language `und`. Repeated rows count as often as they
stand there. A very long text is spread over blocks at ends of pieces. Extra
columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyfilter import KeyFilter
from .shared import keep, numbered
from .wordhash import shingle_hashes

LONGEST = 3
LEAST = 10
#: A longer phrase with so many of 100 occurrences of a shorter one replaces it.
COVER = 50
TOP = 2000
#: Words and ends of pieces of a block: positions take two bytes. A longer piece is a block by itself, of four bytes each.
BLOCK = 1 << 16
#: Blocks that a task fills at once, one for each language.
OPEN = 8
#: Bits of a phrase's hash beyond those that number the words of the corpus. Hashes only prune: chance meetings cost time, no results.
SPARE_BITS = 5
#: Bytes of a batch of blocks on its way to Python.
BATCH_BYTES = 4 << 20
#: Rows that a pass hands on at once.
ROWS = 1 << 16
#: Hashes of occurrences that a task gathers before it sums them.
GATHERED = 1 << 21
#: Occurrences in the corpus for each part of the range of hashes.
PART = 1 << 20
_END = b"\xff"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + _ENDS, bytes(range(ord("a"), ord("z") + 1)) + _END * len(_ENDS))
#: Seed of Spark's xxhash64.
_SEED = 42


def tokens(text: str) -> list[bytes]:
    """The words of a text, and _END after each of its pieces."""
    # No byte of UTF-8 is 0xff; what is left of white space are space and tab.
    return (text.encode().translate(_FOLD) + _END).replace(_END, b" \xff ").split()


class _Lists:
    """Position lists of a block that is being made."""

    def __init__(self) -> None:
        self.parts: list[pa.Array] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(pa.array(words, pa.binary()))
        self.size += len(words)

    def vertical(self) -> tuple[pa.Array, np.ndarray, bytes]:
        """Words, the length of each one's list, and the lists one after the other."""
        own = pa.concat_arrays(self.parts).dictionary_encode()
        words, row = own.dictionary, own.indices.to_numpy()
        lengths = np.bincount(row, minlength=len(words))
        # Numbers of two bytes are sorted by their digits.
        order = np.argsort(row.astype(np.uint16) if len(words) <= 1 << 16 else row, kind="stable")
        end = words.index(_END).as_py()
        first = int(lengths[:end].sum())
        order = np.concatenate((order[:first], order[first + lengths[end] :]))
        words = pa.concat_arrays([words[:end], words[end + 1 :]])
        return words.cast(pa.string()), np.delete(lengths, end), order.astype("<u2" if self.size <= 1 << 16 else "<u4").tobytes()


def postings(docs: DataFrame, text: str = "text", group: str = "lang", block: int = BLOCK) -> DataFrame:
    """A row for each block: lang, words, lengths (of the words' position lists) and positions (these lists, little-endian unsigned integers of 16 bits, or 32 in a longer block)."""
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, _Lists] = {}

        def closed(*langs: str) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                words, lengths, positions = open_blocks.pop(lang).vertical()
                if len(words):
                    whole = pa.array([0, len(words)], pa.int32())
                    lists = [pa.ListArray.from_arrays(whole, x) for x in (words, pa.array(lengths, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), *lists, pa.array([positions], pa.binary())], names=["lang", "words", "lengths", "positions"])

        for batch in batches:
            for lang, own in zip(batch.column(0), batch.column(1), strict=True):
                name = lang.as_py()
                for part in _at_ends(tokens(own.as_py()), block):
                    if name in open_blocks and open_blocks[name].size + len(part) > block:
                        yield from closed(name)
                    if sum(x.size for x in open_blocks.values()) > OPEN * block:
                        yield from closed(*open_blocks)
                    open_blocks.setdefault(name, _Lists()).add(part)
        yield from closed(*open_blocks)

    return rows.mapInArrow(run, "lang string, words array<string>, lengths array<int>, positions binary")


def _at_ends(words: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """The words in parts of about `limit` that end with a piece; a longer piece is a part by itself."""
    at = 0
    while len(words) - at > limit:
        end = at + limit
        while end > at and words[end - 1] != _END:
            end -= 1
        if end == at:
            end = words.index(_END, at + limit) + 1
        yield words[at:end]
        at = end
    yield words[at:]


class _Block:
    """A block of texts laid out by position again: number of the word at each position, -1 at ends of pieces, and the words' hashes."""

    def __init__(self, lang: str, words: pa.Array, lengths: np.ndarray, positions: bytes, bits: int):
        self.words, self._mask = words, np.uint64((1 << bits) - 1)
        at = np.frombuffer(positions, f"<u{len(positions) // int(lengths.sum())}").astype(np.int64)
        self.number = np.full(int(at.max()) + 2, -1, np.int64)
        self.number[at] = np.repeat(np.arange(len(words)), lengths)
        seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
        own = np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_pylist(), repeat(seed)), np.uint64, len(words))
        self.hashes = np.where(self.number >= 0, own[self.number], np.uint64(0))
        #: Positions of all words in order.
        self.at = np.flatnonzero(self.number >= 0)

    def hash_of(self, at: np.ndarray, k: int) -> np.ndarray:
        return shingle_hashes(self.hashes, k)[at] & self._mask if k > 1 else self.hashes[at]

    def extended(self, at: np.ndarray) -> np.ndarray:
        """Of the positions of phrases of k words, those where the next position is one of them too: phrases of k + 1 words."""
        return np.intersect1d(at, at - 1, assume_unique=True)

    def frequent(self, filters: list[KeyFilter]) -> list[np.ndarray]:
        """For k = 1, 2, ..: positions of phrases of k words that may be frequent, by the filter of each level, and of the phrases of one word more that they make."""
        levels, at = [], self.at
        for k, known in enumerate(filters, 1):
            at = at[known.has(self.hash_of(at, k))]
            levels.append(at)
            at = self.extended(at)
        return [*levels, at]

    def named(self, at: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of k words at these positions, and how many there are of each."""
        # Numbered level by level, so that numbers of two levels always fit 64 bits.
        code = self.number[at]
        for j in range(1, k):
            code = np.unique(code, return_inverse=True)[1] * np.int64(len(self.words)) + self.number[at + j]
        _, first, many = np.unique(code, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(self.number[at[first] + j])) for j in range(k)]
        return pc.binary_join_element_wise(*parts, " "), many


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[str, _Block]]:
    for batch in batches:
        lang, words, lengths, positions = (batch.column(k) for k in range(4))
        for i in range(batch.num_rows):
            yield lang[i].as_py(), _Block(lang[i].as_py(), words[i].values, lengths[i].values.to_numpy(), positions[i].as_py(), bits)


def _packed(hashes: list[np.ndarray], bits: int, shift: int, least: int) -> pa.RecordBatch:
    """part, h, f: for each part of the range of hashes, those that are there, less the part's first, and how often, as far as `least` matters; little-endian."""
    h, f = np.unique(np.concatenate(hashes), return_counts=True)
    part = h >> np.uint64(shift)
    edge = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(h)])) if len(h) else np.zeros(1, np.int64)
    low = (h & np.uint64((1 << shift) - 1)).astype(_width(shift))
    many = np.minimum(f, least).astype(_width(least.bit_length()))
    columns = [pa.array(part[edge[:-1]].view(np.int64)), *(pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for x in (low, many))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "h", "f"])


def _width(bits: int) -> str:
    return next(kind for kind, most in (("u1", 8), ("<u4", 32), ("<u8", 64)) if bits <= most)


def _hashed(lists: DataFrame, filters: list[KeyFilter], bits: int, parts: int, least: int) -> DataFrame:
    """h: hashes of phrases of one word more than there are filters, of `bits` bits, that occur `least` times or more.

    parts: in how many parts the range of hashes is summed; a power of two.
    """
    shared = lists.sparkSession.sparkContext.broadcast(filters)  # bounded by keyfilter.MOST_BITS a level
    shift = bits - (parts - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        for _, block in _blocks(batches, bits):
            hashes.append(block.hash_of(block.frequent(shared.value)[-1], len(shared.value) + 1))
            if sum(map(len, hashes)) >= GATHERED:
                yield _packed(hashes, bits, shift, least)
                hashes = []
        if hashes:
            yield _packed(hashes, bits, shift, least)

    def summed(rows: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        h, f = column("h", _width(shift)), column("f", _width(least.bit_length()))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        often = h[first[np.add.reduceat(f[order], first, dtype=np.int64) >= least]].astype(np.uint64)
        return pa.table({"h": (often | np.uint64(rows.column("part")[0].as_py() << shift)).view(np.int64)})

    return lists.mapInArrow(run, "part long, h binary, f binary").groupBy("part").applyInArrow(summed, "h long")


def _named(lists: DataFrame, filters: list[KeyFilter], bits: int) -> DataFrame:
    """lang, phrase, f: phrases of two words and more that may be frequent, with their frequency in a block."""
    shared = lists.sparkSession.sparkContext.broadcast(filters)  # bounded by keyfilter.MOST_BITS a level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches, bits):
            for k, at in enumerate(block.frequent(shared.value)[1:-1], 2):
                phrases, many = block.named(at, k)
                for i in range(0, len(phrases), ROWS):
                    some = phrases[i : i + ROWS]
                    columns = [pa.repeat(pa.scalar(lang), len(some)), some, pa.array(many[i : i + ROWS], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])

    return lists.mapInArrow(run, "lang string, phrase string, f long")


def _words(lengths: str = "lengths") -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_BYTES for the passes that run meanwhile: a block is a large row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent(lists: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, words (their number), phrase, f: every phrase of up to `longest` words that occurs `least` times or more, with its exact frequency, as a table.

    lists: what `postings` gives, from a table.
    """
    each = lists.select("lang", F.explode(F.arrays_zip("words", "lengths")).alias("w"))
    singles = each.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.lengths").alias("f")).where(F.col("f") >= least)
    singles = keep(singles.select("lang", F.lit(1).alias("words"), "phrase", "f"), "phrases-1")
    if longest < 2:
        return singles
    total = int(lists.agg(F.sum(_words())).first()[0] or 0)
    bits = min(64, max(20, total.bit_length() + SPARE_BITS))
    parts = 1 << (total // PART).bit_length()
    filters = [KeyFilter.of(singles.select(F.xxhash64("lang", "phrase").alias("h")), "h")]
    with _small_batches(lists.sparkSession):
        for k in range(2, longest + 1):
            filters.append(KeyFilter.of(keep(_hashed(lists, filters, bits, parts, least), f"phrases-{k}"), "h"))
        more = _named(lists, filters, bits).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        more = more.withColumn("words", F.size(F.split("phrase", " ")))
        return keep(singles.unionByName(more), "phrases")


def _part(first: Column, many: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, many), " ")


def scored(found: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of every phrase of two words or more; found: what `frequent` gives."""
    cuts = found.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - F.lit(1))).alias("cut"))
    cuts = cuts.withColumn("first", _part(F.lit(1), F.col("cut"))).withColumn("rest", _part(F.col("cut") + 1, F.col("words") - F.col("cut")))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    lowest = F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("m")
    return cuts.groupBy("lang", "words", "phrase", "a").agg(lowest).select("lang", "words", "phrase", "a", "m.l", "m.r", "m.score")


def uncovered(candidates: DataFrame, found: DataFrame, cover: int = COVER) -> DataFrame:
    """candidates without those for which a longer frequent phrase that holds them has `cover` of 100 of their occurrences or more."""
    longer = found.where("words > 2")
    many = F.explode(F.sequence(F.lit(2), F.col("words") - F.lit(1)))
    inner = longer.select("lang", "words", "phrase", "f", many.alias("many"))
    inner = inner.select("lang", "phrase", "f", "many", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("many") + F.lit(1))).alias("at"))
    inner = inner.select("lang", _part(F.col("at"), F.col("many")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(inner, ["lang", "phrase"], "left")
    return kept.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover)).drop("most")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` of each language by score, frequency and phrase."""
    lists = keep(postings(docs, text, group), "postings", compression="zstd")
    found = frequent(lists, longest, least)
    totals = lists.groupBy("lang").agg(F.sum(_words()).alias("n"))
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    placed = numbered(uncovered(scored(found), found, cover), order, "place")
    # Ranges are in order of languages: a language's rank is counted from its first place.
    starts = placed.groupBy("lang").agg(F.min("place").alias("start"))
    ranked = placed.join(starts, "lang").where(F.col("place") < F.col("start") + top)
    ranked = ranked.join(totals, "lang").withColumn("rank", F.col("place") - F.col("start") + 1)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_of_documents(docs: DataFrame) -> DataFrame:
    """Digest of operator 12, by language."""
    return collocations(docs)


#: The same by counting every phrase of every piece.
ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
cut as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
every as (
  select lang, unnest(w) as phrase, 1 as words from cut
  union all
  select lang, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]), 2 from cut
  union all
  select lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]), 3 from cut),
counted as (
  select lang, phrase, words, count(*)::hugeint as f from every group by all),
totals as (
  select lang, sum(f)::bigint as n from counted where words = 1 group by lang),
candidates as (
  select lang, phrase, words, f as a, string_split(phrase, ' ') as w from counted where words > 1 and f >= 10),
cuts as (
  select lang, phrase, words, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from candidates, unnest([1, 2]) as t(k) where k < words),
scores as (
  select c.lang, c.phrase, c.words, c.a, c.k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f * y.f) as score
  from cuts c join counted x on x.lang = c.lang and x.phrase = c.first join counted y on y.lang = c.lang and y.phrase = c.rest),
lowest as (
  select lang, phrase, words, a, l, r, score from scores
  qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_phrases as (
  select lang, phrase, max(a) as most from (
    select lang, w[1] || ' ' || w[2] as phrase, a from candidates where words = 3
    union all
    select lang, w[2] || ' ' || w[3], a from candidates where words = 3)
  group by all),
kept as (
  select s.* from lowest s left join inner_phrases i on i.lang = s.lang and i.phrase = s.phrase
  where i.most is null or 100 * i.most < 50 * s.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
  qualify rank <= 2000)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang)
"""
