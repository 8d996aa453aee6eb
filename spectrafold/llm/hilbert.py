"""Sharding along a Hilbert curve (operator 4, DataFrame functions only).

Several metadata dimensions of each row are quantised to `bits` bits, the cell
is turned into its index on the Hilbert curve, rows are ordered by that index
and the order is cut into runs. Neighbours on the curve are neighbours in every
dimension, so a shard's least and greatest value of each dimension lie nearer to
each other than those of all rows, and filters on any of them skip files. How
many is measured in the tests and the README. Cells of a category follow the
order of its values, by the share of the rows that lie before a value, so that
least and greatest values mean something; equal values share a cell.

Law: `rows`. Shards differ by at most one row, so a hot value cannot make a
large shard: a run is cut wherever the count says, in the middle of a cell or
of equal rows if need be.

Scale: rows are narrow when they are dealt (ids, sizes and cells, no text). The
order is a range partitioning on (index, row hash, id), whose ties are split by
the hash; ranks come from each range's size, one row per partition, so nothing
passes through one task. Null values of a dimension take cell 0, null ids sort
first, repeated rows get one slot each, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, unused

SHARDS = 40
BITS = 5


def _state_table(dims: int) -> tuple[list[int], list[int]]:
    """Hilbert automaton: for state s and octant o, entry s * 2^dims + o has the curve digit and the next state.

    A state is (entry corner, direction), after the published compact Hilbert index rules.
    """
    cells, mask = 1 << dims, (1 << dims) - 1

    def turn(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask if k else x

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def ungray(g: int) -> int:
        i = 0
        while g:
            i ^= g
            g >>= 1
        return i

    def entry(i: int) -> int:
        return gray(2 * ((i - 1) // 2)) if i else 0

    def ones(i: int) -> int:
        n = 0
        while i & 1:
            n, i = n + 1, i >> 1
        return n

    def direction(i: int) -> int:
        return 0 if i == 0 else ones(i - 1) % dims if i % 2 == 0 else ones(i) % dims

    digit, follow = [], []
    for state in range(cells * dims):
        corner, towards = divmod(state, dims)
        for octant in range(cells):
            w = ungray(turn(octant ^ corner, dims - (towards + 1) % dims))
            next_corner = corner ^ turn(entry(w), towards + 1)
            digit.append(w)
            follow.append(next_corner * dims + (towards + direction(w) + 1) % dims)
    return digit, follow


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates, each 0 to 2^bits - 1."""
    dims = len(cells)
    digits, follows = _state_table(dims)
    digit = F.array(*[F.lit(x) for x in digits])
    follow = F.array(*[F.lit(x) for x in follows])
    point = F.array(*[c.cast("int") for c in cells])

    def step(acc: Column, level: Column) -> Column:
        octant = F.lit(0)
        for k in range(dims):
            bit = F.call_function("shiftright", F.get(point, F.lit(k)), level).bitwiseAND(F.lit(1))
            octant = octant + bit * F.lit(1 << k)
        at = acc["state"] * F.lit(1 << dims) + octant
        return F.struct((acc["index"] * F.lit(1 << dims) + F.get(digit, at)).cast("long").alias("index"), F.get(follow, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)]), start, step, lambda acc: acc["index"])


def log_cell(value: Column, bits: int = BITS) -> Column:
    """Logarithmic cell of a size: three cells to two doublings."""
    cell = F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(1)).cast("double")) * 1.5)
    return F.least(cell, F.lit((1 << bits) - 1)).cast("int")


def ordered_cell(rows: DataFrame, value: Column, bits: int = BITS) -> Column:
    """Cell of a category, in the order of its values; null has cell 0.

    Counts of all values are summed up in their order; a value's cell is the share of the rows before its middle row.
    What the driver gets is the least value of each cell, 2^bits at most, however many values there are.
    """
    counts = rows.where(value.isNotNull()).groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("many"))
    placed = keep(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("place", F.monotonically_increasing_id()), "values")
    parts = placed.withColumn("part", F.shiftright("place", 33))
    sizes = parts.groupBy("part").agg(F.sum("many").alias("rows"))
    # The window sees one row a range of values.
    sizes = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    total = F.sum("many").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    summed = parts.withColumn("until", total).join(F.broadcast(sizes), "part")
    all_rows = placed.agg(F.sum("many")).first()[0] or 1
    middle = F.col("ahead") + F.col("until") - F.shiftright(F.col("many") + 1, 1)
    cells = summed.groupBy(F.floor(middle * (1 << bits) / all_rows).alias("cell")).agg(F.min("value").alias("least"))
    least = [(r["least"], int(r["cell"])) for r in cells.orderBy("cell").collect()]
    out = F.lit(0)
    for x, cell in least:
        out = F.when(value.cast("string") >= F.lit(x), F.lit(cell)).otherwise(out)
    return F.when(value.isNull(), F.lit(0)).otherwise(out).cast("int")


def shard_by_hilbert(rows: DataFrame, cells: dict[str, Column], key: str, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """rows with columns `hilbert`, `shard` (0 to shards - 1) and `slot` (0.. within the shard), counts at most one apart.

    cells: name to coordinate; key: the id column, which breaks ties after the row hash.
    Columns of those three names in `rows` are replaced. Carry narrow rows and join wide ones by key afterwards.
    """
    rows = rows.drop("hilbert", "shard", "slot")
    place, tie, part, many, before, total = unused([*rows.columns, "hilbert", "shard", "slot"], "place", "tie", "part", "many", "before", "total")
    placed = rows.withColumn("hilbert", hilbert_index(list(cells.values()), bits)).withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    placed = placed.repartitionByRange("hilbert", tie, key).sortWithinPartitions("hilbert", tie, key)
    placed = keep(placed.drop(tie).withColumn(place, F.monotonically_increasing_id()), "hilbert")
    of, row = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: their sizes, then how many rows lie before each. The window sees partitions, not rows.
    sizes = placed.groupBy(of.alias(part)).agg(F.count("*").alias(many))
    ahead = F.sum(many).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    all_rows = F.sum(many).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = sizes.select(part, F.coalesce(ahead, F.lit(0)).alias(before), all_rows.alias(total))
    ranked = placed.withColumn(part, of).join(F.broadcast(starts), part)
    # Shard s holds ranks [ceil(s n / shards), ceil((s + 1) n / shards)).
    rank = F.col(before) + row
    shard = F.call_function("div", rank * shards, F.col(total)).cast("int")
    first = F.call_function("div", F.col("shard") * F.col(total) + F.lit(shards - 1), F.lit(shards).cast("bigint"))
    return ranked.withColumn("shard", shard).withColumn("slot", rank - first).drop(part, before, total, place)


CELLS = ("source_cell", "lang_cell", "size_cell")


def _cells(docs: DataFrame) -> dict[str, Column]:
    return dict(zip(CELLS, (ordered_cell(docs, F.col("source")), ordered_cell(docs, F.col("lang")), log_cell(_size())), strict=True))


def _size() -> Column:
    return (F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)) + F.lit(16)).cast("long")


def document_cells(docs: DataFrame) -> DataFrame:
    """The narrow row that operator 4 deals for each document: doc_id, size, text_crc32 and its cells."""
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return docs.select("doc_id", _size().alias("size"), crc.alias("text_crc32"), *[cell.alias(c) for c, cell in _cells(docs).items()])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Digest of the sharding of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    cells = {c: F.col(c) for c in CELLS}
    return shard_by_hilbert(document_cells(docs), cells, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents as Parquet, one folder `shard=n` a shard, each file a run of the curve; texts are shuffled once."""
    docs = docs.drop("hilbert", "shard", "slot")
    cells = dict(zip(CELLS, unused(docs.columns, *CELLS), strict=True))
    found = docs.withColumns({cells[c]: cell for c, cell in _cells(docs).items()})
    placed = shard_by_hilbert(found, {c: F.col(c) for c in cells.values()}, "doc_id", shards)
    placed.drop("hilbert", *cells.values()).write.partitionBy("shard").parquet(path)
