"""N-gram Jaccard join (operator 9): adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles, as tokens. Equal sets
form a class and go on as one. A class that links with another shares at least
three quarters of its own tokens with it, so only classes of which so many
tokens occur in other classes at all can link; the others end here.

Tokens have one global order: by the number of classes that can link and have
them, counted over all of these, rare ones first. By the prefix lemma two sets that link
share at least l tokens among the first n - ceil(0.75 n) + l of each, for any l
up to the needed overlap. Every class picks its own l, from 1 to a quarter of
its tokens, where the estimated cost is least: a longer prefix has more
postings but asks for more shared tokens before verification. A pair must share
the lesser l of the two, each at a place from which on the link is still
possible. What meets is verified on whole sets.

Dense groups: of each token's postings the class with the largest share of
common tokens is the pivot. A first round verifies each class against its best
pivot only and joins what links; the second round takes every pair that shares
enough prefix tokens and is not joined yet. A group of m near copies so costs
about m verifications, and no link between different components is lost.

Scale: texts are read once by a map and never shuffled. Tokens that two classes
of one block of texts have are known as common there; each distinct token of a
block travels once, packed with the others of its bucket (about 10 bytes), to
the task that sees it from all blocks. A token that every text has is one entry
a block. What is common goes back by class in the same packed way, to the task
that counts how much of a class is. All that follows are joins and sums of
classes that can link. Tokens
of many classes and classes of many pairs are dealt with a salt by their known
numbers. Components are found by joins that pass least labels and double their
reach. Nothing of the corpus reaches the driver.

A null, empty or blank text has no set and links with nothing. Texts of fewer
than five words have one shingle, the whole sequence. Repeated rows are copies;
rows with a null id link as others do and take the least id of their component,
null if it has none. Ids may be of any ordered type. Extra columns are dropped
by `join` and kept by `keep_one`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .shared import forget, keep, parts, unused

WIDTH = 5
#: Two sets link when NUM * union <= DEN * intersection.
NUM, DEN = 3, 4
#: Tokens and classes of a block that are looked at together. Owners in a block are numbered in 16 bits.
BLOCK_TOKENS = 1_000_000
BLOCK_CLASSES = 60_000
#: Postings of a token, or pairs of a class, for each salt.
SALTED = 256
#: Cost of a token of a verification, where that of a row of the join is 1.
CHECK = 1 / 64
#: A token keeps so many low bits beside the number of its bucket.
LOW_BITS = 48
_LOW = np.uint64((1 << LOW_BITS) - 1)


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    mixed = wordhash.mix(tokens)
    both = np.array([mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed), len(tokens)], np.uint64)
    a = wordhash.mix(both[:1])
    b = wordhash.mix(a ^ both[1:2])
    return int(wordhash.mix(b ^ both[2:]).view(np.int64)[0])


def needed(n: int) -> int:
    """Least overlap of a set of n tokens with any set that it links with."""
    return -(-NUM * n // DEN)


def buckets_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """0 to buckets - 1, rising with the token."""
    return (tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)


def _six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


#: Kinds of rows that travel: a document, tokens of one class of a block, tokens of more of them, tokens of each class that another class of the block has.
DOCUMENT, ALONE, COMMON, HELD = range(4)
#: A class beside its tokens: its name and the size of its set.
_CLASS = np.dtype([("class", "<i8"), ("n", "<i4")])
#: Tokens that wait before repeated ones are dropped.
WAITING = 4_000_000
#: Rows that travelled are unpacked, and rows with so many bytes packed, at once.
UNPACKED, PACKED_BYTES = 256, 4_000_000
#: A bucket is sorted in parts, by the first of the low bits of its tokens.
PART_BITS = 3


class Sets:
    """Tokens of classes, each once for a class, however often they are added."""

    def __init__(self):
        self.tokens = np.zeros(0, np.uint64)
        self.of = np.zeros(0, _CLASS)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, tokens: np.ndarray, of: np.ndarray) -> None:
        """A class of each token."""
        self.new.append((tokens, of))
        self.waiting += len(tokens)
        if self.waiting > max(WAITING, len(self.tokens)):
            self.sorted()

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens by class, the classes and how many tokens each has."""
        if self.new:
            tokens = np.concatenate([self.tokens, *[t for t, _ in self.new]])
            of = np.concatenate([self.of, *[c for _, c in self.new]])
            self.tokens = self.of = None  # not held beside their copies
            self.new, self.waiting = [], 0
            order = np.lexsort((tokens, of["class"]))
            tokens, of = tokens[order], of[order]
            del order
            once = np.ones(len(tokens), bool)
            once[1:] = (tokens[1:] != tokens[:-1]) | (of["class"][1:] != of["class"][:-1])
            self.tokens, self.of = tokens[once], of[once]
        start = np.flatnonzero(np.append(True, self.of["class"][1:] != self.of["class"][:-1])[: len(self.of)])
        return self.tokens, self.of[start], np.diff(np.append(start, len(self.of)))


def by_bucket(buckets: int, spread: int, tokens: np.ndarray, of: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """(bucket, tokens, counts, classes): the classes dealt to buckets by name and `spread`, a row for each bucket."""
    where = (of["class"].astype(np.uint64) + np.uint64(spread)) % np.uint64(buckets)
    order = np.argsort(where, kind="stable")
    each = np.argsort(np.repeat(where, counts), kind="stable")
    tokens, of, counts, where = tokens[each], of[order], counts[order], where[order]
    cuts = np.searchsorted(where, np.arange(buckets + 1))
    ends = np.concatenate(([0], np.cumsum(counts)))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[b], cuts[b + 1]
        yield b, tokens[ends[lo] : ends[hi]].tobytes(), counts[lo:hi].astype("<i4").tobytes(), of[lo:hi].tobytes()


def from_bucket(tokens: bytes, counts: bytes, classes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and the class of each."""
    return np.frombuffer(tokens, np.uint64), np.repeat(np.frombuffer(classes, _CLASS), np.frombuffer(counts, "<i4"))


class Block:
    """Sets of some classes. entries(): (bucket, kind, tokens, owners, classes), the rows that travel."""

    def __init__(self, buckets: int, most_tokens: int, most_classes: int):
        self.buckets, self.most_tokens, self.most_classes = buckets, most_tokens, most_classes
        self.classes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.seen: set[int] = set()
        self.size = 0

    def add(self, own: int, tokens: np.ndarray) -> None:
        if own not in self.seen:
            self.seen.add(own)
            self.classes.append(own)
            self.sets.append(tokens)
            self.size += len(tokens)

    @property
    def full(self) -> bool:
        return self.size >= self.most_tokens or len(self.classes) >= self.most_classes

    def entries(self) -> Iterator[tuple]:
        if not self.sets:
            return
        sizes = [len(s) for s in self.sets]
        tokens = np.concatenate(self.sets)
        owners = np.repeat(np.arange(len(self.sets), dtype=np.uint16), sizes)
        classes = np.zeros(len(self.sets), _CLASS)
        classes["class"], classes["n"] = self.classes, sizes
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        start = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        alone = start & np.concatenate((start[1:], [True]))
        # Tokens of one class of the block: with their owners.
        mine, whose = tokens[alone], owners[alone]
        cuts = np.searchsorted(buckets_of(mine, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            here = slice(cuts[b], cuts[b + 1])
            used, place = np.unique(whose[here], return_inverse=True)
            yield b, ALONE, _six(mine[here]), place.astype("<u2").tobytes(), classes[used].tobytes()
        # Tokens of two or more: once for the other blocks, and as known to be common for each of their classes.
        common = tokens[start & ~alone]
        cuts = np.searchsorted(buckets_of(common, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            yield b, COMMON, _six(common[cuts[b] : cuts[b + 1]]), None, None
        short = buckets_of(tokens, self.buckets) << np.uint64(LOW_BITS) | tokens & _LOW
        shared, whose = short[~alone], owners[~alone]
        shared, many = shared[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(classes))
        # Blocks deal a class differently: one that all blocks have is not sent to one task by all of them.
        for b, some, counts, of in by_bucket(self.buckets, self.classes[0] & 0xFFFF, shared, classes[many > 0], many[many > 0]):
            yield b, HELD, some, counts, of


_TRAVEL = "bucket int, kind tinyint, {id}, text_hash bigint, class bigint, n int, tokens binary, owners binary, classes binary"
_SCANNED = "bucket int, {id}, text_hash bigint, class bigint, n int, tokens binary, counts binary, classes binary"


def _buckets(docs: DataFrame) -> int:
    return min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 15)


def _scanned(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each document (bucket null), and rows of a bucket of classes (n null) with tokens of them that other classes have too."""
    limits = buckets, BLOCK_TOKENS, BLOCK_CLASSES
    doc_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    kinds = [pa.int32(), pa.int8(), None, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "kind", "doc_id", "text_hash", "class", "n", "tokens", "owners", "classes"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*limits)

        def packed(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal block
            rows: list[tuple] = []
            for bucket, what, tokens, owners, classes in block.entries():
                rows.append((bucket, what, None, None, None, None, tokens, owners, classes))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            block = Block(*limits)

        pa.default_memory_pool().release_unused()  # of what this worker did before
        kind, sent = None, 0
        for batch in parts(batches):
            kind, classes, sizes = batch.column(0).type, [], []
            for tokens in wordhash.shingle_sets(batch.column(2).to_pylist(), WIDTH):
                own = class_of(tokens) if len(tokens) else None
                classes.append(own)
                sizes.append(len(tokens))
                if own is not None:
                    block.add(own, tokens)
                    if block.full:
                        yield from packed(kind)
            n = batch.num_rows
            where = pa.array(np.arange(sent, sent + n) % buckets, pa.int32())
            sent += n
            columns = [where, pa.array(np.full(n, DOCUMENT, np.int8)), batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, pa.binary())] * 3], names=names)
        if kind is not None:
            yield from packed(kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        known: list[np.ndarray] = []
        held = Sets()
        kind, named = None, 0
        pa.default_memory_pool().release_unused()
        for whole in batches:
            kind = whole.column(2).type
            for batch in parts([whole], UNPACKED):
                documents = pc.equal(batch.column(1), DOCUMENT)
                if documents.true_count:
                    rows = batch.filter(documents)
                    n = rows.num_rows
                    yield made(pa.nulls(n, pa.int32()), *rows.columns[2:6], *[pa.nulls(n, pa.binary())] * 3)
                batch = batch.filter(pc.invert(documents))
                for bucket, what, x, o, of in zip(*[batch.column(k).to_pylist() for k in (0, 1, 6, 7, 8)], strict=True):
                    if what == HELD:
                        held.add(*from_bucket(x, o, of))
                        continue
                    short = _from_six(x) | np.uint64(bucket << LOW_BITS)
                    if what == COMMON:
                        known.append(short)
                    else:
                        # An owner is the place of its class among all that came: 4 bytes a token.
                        tokens.append(short)
                        owners.append(np.frombuffer(o, "<u2").astype(np.int32) + np.int32(named))
                        classes.append(np.frombuffer(of, _CLASS))
                        named += len(classes[-1])
        whole = batch = documents = rows = x = o = of = short = None
        if tokens:
            every = np.concatenate(tokens)
            tokens.clear()
            owner = np.concatenate(owners)
            owners.clear()
            names = np.concatenate(classes)
            classes.clear()
            elsewhere = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
            known.clear()
            for part in range(1 << PART_BITS):
                here = (every & _LOW) >> np.uint64(LOW_BITS - PART_BITS) == part
                token, of = every[here], names[owner[here]]
                if not len(token):
                    continue
                order = np.argsort(token)
                token, of = token[order], of[order]
                start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                # Of a token of two classes some two neighbours differ.
                differs = np.append((token[1:] == token[:-1]) & (of["class"][1:] != of["class"][:-1]), False)
                common = np.logical_or.reduceat(differs, start) | np.isin(token[start], elsewhere)
                shared = np.repeat(common, np.diff(np.append(start, len(token))))
                held.add(token[shared], of[shared])
            del every, owner, names, elsewhere, here, token, of, order, differs
        ready, size = [], 0
        for row in by_bucket(buckets, 0, *held.sorted()):
            ready.append(row)
            size += sum(map(len, row[1:]))
            if size >= PACKED_BYTES:
                yield packed_classes(ready, kind)
                ready, size = [], 0
        if ready:
            yield packed_classes(ready, kind)

    def packed_classes(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        bucket, *packed = zip(*rows, strict=True)
        n = len(rows)
        none = [pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
        return made(pa.array(bucket, pa.int32()), *none, *[pa.array(c, pa.binary()) for c in packed])

    def made(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["bucket", "doc_id", "text_hash", "class", "n", "tokens", "counts", "classes"])

    sent = rows.mapInArrow(send, _TRAVEL.format(id=doc_id)).repartitionById(buckets, F.col("bucket"))
    return keep(sent.mapInArrow(meet, _SCANNED.format(id=doc_id)), "scanned")


def _classes(scanned: DataFrame, buckets: int) -> DataFrame:
    """class, n and the tokens that other classes have too, of the classes that have enough of them to link."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sets()
        pa.default_memory_pool().release_unused()
        for batch in parts(batches, UNPACKED):
            for row in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                held.add(*from_bucket(*row))
        batch = row = None
        tokens, of, counts = held.sorted()
        held = None
        able = NUM * of["n"].astype(np.int64) <= DEN * counts
        tokens, of, counts = tokens[np.repeat(able, counts)], of[able], counts[able]
        ends = np.concatenate(([0], np.cumsum(counts)))
        for at in range(0, len(of), 4096):
            some = ends[at : at + 4097]
            lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(tokens[some[0] : some[-1]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(of[name][at : at + 4096])) for name in _CLASS.names], lists], names=["class", "n", "tokens"])

    packed = scanned.where(F.col("n").isNull()).select("bucket", "tokens", "counts", "classes")
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(gather, "class bigint, n int, tokens array<bigint>")


def _salt(of: str, number: Column) -> Column:
    """One of `number` salts, by the value of a column."""
    return F.pmod(F.xxhash64(of), number).cast("int")


def _salts(number: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (number - F.lit(1)).cast("int")))


def _counted(tokens: DataFrame) -> DataFrame:
    """The tokens that two classes or more have, with the number f of these classes."""
    common = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    return tokens.join(common, "token")


def _able(n: str, held: Column) -> Column:
    return NUM * F.col(n) <= DEN * held


def _tokens(classes: DataFrame) -> DataFrame:
    """class, n, token, f: tokens that two classes have, of the classes that have enough of them to link."""
    rows = classes.select("class", "n", F.explode("tokens").alias("token"))
    held = F.count("*").over(Window.partitionBy("class"))
    # Tokens shared with classes that cannot link are no help.
    left = _counted(rows).withColumn("held", held).where(_able("n", F.col("held"))).select("class", "n", "token")
    left = keep(left, "able")
    out = keep(_counted(left), "counted")
    forget(left)
    return out


def postings(tokens: DataFrame) -> DataFrame:
    """token, class, n, f, place in the global order, matches asked for, and share: the percentage of common tokens; the prefixes alone."""
    own = Window.partitionBy("class")
    order = own.orderBy("f", "token")
    base = F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("int")
    # A partner of the same size needs NUM / (NUM + DEN) of both, so it is met at the first places only: those are reckoned with.
    near = F.col("n") - F.ceil(F.col("n") * (2 * NUM) / (NUM + DEN)).cast("int")
    placed = tokens.withColumn("held", F.count("*").over(own)).withColumn("place", (F.col("n") - F.col("held") + F.row_number().over(order) - 1).cast("int"))
    placed = placed.withColumn("met", F.sum(F.col("f") - 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    matches = F.col("place") - near + 1
    most = F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int")), F.col("n") - base)
    # What is met costs a row each; of those met l times or more, of which there are at most 1 / l, each costs a verification.
    cost = F.col("met") * (1 + CHECK * F.col("n") / matches)
    best = F.min(F.when((matches >= 1) & (matches <= most), F.struct(cost.alias("cost"), matches.alias("matches")))).over(own)
    # Where the first places have no common token at all, one match is enough to ask for.
    asked = F.when(F.col("n") - F.col("held") > near, F.lit(1)).otherwise(F.coalesce(F.col("best.matches"), F.lit(1)))
    chosen = placed.withColumn("best", best).withColumn("matches", asked).where(F.col("place") < base + F.col("matches"))
    share = F.floor(F.lit(100) * F.col("held") / F.col("n")).cast("int")
    return chosen.select("token", "class", "n", "f", "place", "matches", share.alias("share"))


def _reach(a: Column, b: Column, after: Column) -> Column:
    """|x & y| >= NUM / DEN * |x | y| is the same as (NUM + DEN) * |x & y| >= NUM * (|x| + |y|)."""
    return (NUM + DEN) * after >= NUM * (a + b)


def _sizes_fit(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _spread(number: str) -> Column:
    return F.ceil(F.col(number) / SALTED)


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """x, y: each class with the pivot with which it shares most tokens."""
    pivots = rows.groupBy("token").agg(F.max(F.struct("share", "n", "class", "matches")).alias("p"), F.max("f").alias("f"))
    pivots = pivots.select("token", F.col("p.class").alias("y"), F.col("p.n").alias("yn"), F.col("p.matches").alias("ym"), _salts(_spread("f")).alias("salt"))
    met = rows.withColumn("salt", _salt("class", _spread("f"))).join(pivots, ["token", "salt"]).where((F.col("class") != F.col("y")) & _sizes_fit(F.col("n"), F.col("yn")))
    votes = met.groupBy(F.col("class").alias("x"), "y").agg(F.count("*").alias("votes"), F.min(F.least("matches", "ym")).alias("demand"))
    return votes.where("votes >= demand").groupBy("x").agg(F.max(F.struct("votes", "y")).alias("best")).select("x", F.col("best.y").alias("y"))


def _open_pairs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """x, y: pairs of different components that share as many prefix tokens as the lesser of their two demands.

    From the j-th shared token of a link on there are j - 1 fewer tokens than the overlap: the first l shared ones all
    stand at places that leave the needed overlap but l - 1 in both sets, and the first leaves all of it.
    """
    own = rows.join(labels, rows["class"] == labels["node"], "left").select("token", "class", "n", "f", "place", "matches", F.coalesce("label", "class").alias("comp"))
    own = keep(own, "labelled")
    mixed = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    own = own.join(mixed, "token", "left_semi")
    a = own.withColumn("salt", _salt("class", _spread("f"))).alias("a")
    b = own.withColumn("salt", _salts(_spread("f"))).alias("b")
    after = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    demand = F.least("a.matches", "b.matches")
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.comp") != F.col("b.comp")) & (F.col("a.class") < F.col("b.class"))
    met = a.join(b, on & _sizes_fit(F.col("a.n"), F.col("b.n")) & _reach(F.col("a.n"), F.col("b.n"), after + demand - 1))
    pairs = met.groupBy(F.col("a.class").alias("x"), F.col("b.class").alias("y")).agg(
        F.count("*").alias("shared"), F.min(demand).alias("demand"), F.max(after).alias("after"), F.min("a.n").alias("xn"), F.min("b.n").alias("yn")
    )
    return pairs.where((F.col("shared") >= F.col("demand")) & _reach(F.col("xn"), F.col("yn"), F.col("after"))).select("x", "y")


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y: classes) whose whole sets link. sets: class, n and tokens, of which those that no other class has may be left out."""
    pairs = keep(pairs, "pairs")
    # Of each pair one set travels to the other, that of the class in fewer pairs; a class with many is met in several tasks.
    degree = keep(pairs.select(F.col("x").alias("c")).unionAll(pairs.select(F.col("y").alias("c"))).groupBy("c").agg(F.count("*").alias("d")), "degrees")
    dx, dy = degree.select(F.col("c").alias("x"), F.col("d").alias("dx")), degree.select(F.col("c").alias("y"), F.col("d").alias("dy"))
    at_y = F.struct("dy", "y") >= F.struct(F.col("dx"), F.col("x"))
    way = pairs.join(dx, "x").join(dy, "y").select(
        F.when(at_y, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(at_y, F.col("y")).otherwise(F.col("x")).alias("y"), F.greatest("dx", "dy").alias("d")
    )
    way = way.withColumn("salt", _salt("x", _spread("d"))).drop("d")
    sent = way.join(sets.select(F.col("class").alias("x"), F.col("n").alias("xn"), F.col("tokens").alias("xs")), "x")
    home = sets.join(degree, sets["class"] == degree["c"]).select(F.col("class").alias("y"), F.col("n").alias("yn"), F.col("tokens").alias("ys"), _salts(_spread("d")).alias("salt"))
    met = sent.join(home, ["y", "salt"]).withColumn("both", F.size(F.array_intersect("xs", "ys")))
    links = keep(met.where(DEN * F.col("both") >= NUM * (F.col("xn") + F.col("yn") - F.col("both"))).select("x", "y"), "links")
    forget(pairs, degree)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that each node of the links x, y reaches."""
    edges = keep(links.select("x", "y").unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    kept = keep(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        labels = kept.select("node", "label")
        near = labels.select(F.col("node").alias("y"), F.col("label").alias("theirs"))
        least = edges.join(near, "y").groupBy(F.col("x").alias("node")).agg(F.min("theirs").alias("theirs"))
        passed = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        # A label is a node itself: its own label may reach further.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = keep(passed.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        forget(kept)
        kept = new
        if new.where("old <> label").isEmpty():
            forget(edges)
            return new.select("node", "label")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class, n_shingles, label of the component and component_id of every document; class and label are null without a set."""
    buckets = _buckets(docs)
    scanned = _scanned(docs, buckets)
    tokens = _tokens(_classes(scanned, buckets))
    sets = keep(tokens.groupBy("class", "n").agg(F.collect_list("token").alias("tokens")), "sets")  # bounded by a document's own words
    prefixes = keep(postings(tokens), "postings")
    forget(tokens)
    first = verify(sets, _pivot_pairs(prefixes))
    labels = components(first)
    second = verify(sets, _open_pairs(prefixes, labels))
    # What the second round found links components of the first.
    labels = components(first.unionAll(second))
    forget(sets, prefixes, first, second)
    classes = scanned.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    group = keep(classes.join(labels, classes["class"] == labels["node"], "left").select("class", "least", F.coalesce("label", "class").alias("label")), "group")
    # A table of its own, so that a component of very many classes is a skewed join that Spark may split.
    least = keep(group.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = keep(group.join(least, "label").select("class", "label", "component_id"), "named")
    forget(group, least)
    own = scanned.where(F.col("n").isNotNull()).select("doc_id", "text_hash", "class", F.col("n").cast("bigint").alias("n_shingles"))
    grouped = own.where(F.col("class").isNotNull()).join(named, "class").select("doc_id", "text_hash", "class", "n_shingles", "label", "component_id")
    none = F.lit(None).cast("bigint")
    return grouped.unionByName(own.where(F.col("class").isNull()).select("doc_id", "text_hash", "class", "n_shingles", none.alias("label"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, the least id that is not null and then the least text hash; rows without a set all stay.

    Rows to drop, and those that repeat a row to keep, are looked up by id and text hash; each text is shuffled once.
    """
    own, key, what, place = unused(docs.columns, "own", "key", "what", "place")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = join(docs).where(F.col("label").isNotNull())
    best = rows.groupBy("label").agg(F.min(rank).alias("k"), F.count("*").alias("many")).where("many > 1").select("label", "k")
    first = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))
    judged = rows.join(best, "label").select(F.col("text_hash").alias(own), F.xxhash64("doc_id").alias(key), first.alias(what)).distinct()
    judged = keep(judged, "judged")
    met = docs.withColumn(own, F.xxhash64("text")).withColumn(key, F.xxhash64("doc_id")).join(judged.hint("merge"), [own, key], "left")
    met = met.withColumn(place, F.row_number().over(Window.partitionBy(own, key).orderBy(own)))
    return met.where(F.col(what).isNull() | (F.col(what) & (F.col(place) == 1))).select(*docs.columns)


def link_documents(docs: DataFrame) -> DataFrame:
    """Digest of operator 9: doc_id, n_shingles, component_id."""
    return join(docs).select("doc_id", "n_shingles", "component_id")
