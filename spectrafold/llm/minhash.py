"""Document fingerprints (operator 10, DataFrame functions only).

One-permutation MinHash. Each 5-word shingle of a text (words split at white
space, lower case; fewer words make one shingle) is hashed once; the top 7 bits
name one of 128 bins and each bin keeps its smallest hash. An empty bin borrows
from the first filled bin in its own sequence of hashed bins (optimal
densification: the choice depends only on which bins are filled, so equal sets
agree). Of each bin the low 8 bits are stored; likeness
is the share of equal bins, corrected for the 1/256 chance of equal low bits.

Null and empty texts (and texts of white space) have no shingle: their
fingerprint is the empty string; two such are alike 1, such and another 0.

`fingerprint_with_next` pairs each document with the next one by descending id
without a global window: ids are cut into ranges at approximate quantiles, each
range is a window of its own, and the first document of a range is also dealt
to the range before it (that of the first range to the last, which closes the
circle). An id that very many rows have, or null, is cut into further ranges by
the beginning of the text; only rows that agree in id and the first 32
characters stay in one range. Every text is shuffled once. Repeated ids follow
each other by text; null ids come last; other than integer ids raise a
TypeError. Extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .shared import unused

BINS = 128
LOW_BITS = 8
WIDTH = 5
_SHIFT = 57
#: Ranges of ids for each shuffle partition.
RANGES_PER_PARTITION = 4
#: Characters of a text by which a frequent id is cut, and texts looked at for each such cut.
OPENING, LOOKED_AT = 32, 16


#: For each of a few tries, the bin that an empty bin looks at: hashes of bin and try.
_TRIES = [", ".join(str(zlib.crc32(f"{t}:{b}".encode()) % BINS) for b in range(BINS)) for t in range(12)]


def _bin(x: Column) -> Column:
    """0 to 127, rising with the signed hash."""
    return F.shiftright(x, _SHIFT).cast("int") + F.lit(BINS // 2)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out` (in place of an own column of that name): array<tinyint> of 128 low bytes, or an empty array for a text without words."""
    hashes, pairs, shingles, firsts, slots, filled = unused([*df.columns, out], "h", "p", "s", "m", "slots", "filled")
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col(hashes), F.size(hashes)

    def joined(x: Column, y: Column, apart: int, size: Column) -> Column:
        """Hash of x[i] and y[i + apart], for `size` places."""
        return F.zip_with(F.slice(x, F.lit(1), size), F.slice(y, F.lit(1 + apart), size), lambda a, b: F.xxhash64(a, b))

    # Words i and i + 1, then the pairs at i and i + 2, then word i + 4: five words.
    df = df.withColumn(pairs, F.when(n >= WIDTH, joined(h, h, 1, n - F.lit(1))))
    runs = joined(joined(F.col(pairs), F.col(pairs), 2, n - F.lit(3)), h, WIDTH - 1, n - F.lit(WIDTH - 1))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(shingles, F.when(n >= WIDTH, F.sort_array(runs)).when(n > 0, F.array(F.xxhash64(h))).otherwise(none)).drop(hashes, pairs)
    s = F.col(shingles)
    # The first of each bin: the top bits differ from those of the hash before.
    first = F.filter(s, lambda x, i: F.shiftrightunsigned(x.bitwiseXOR(F.get(s, i - F.lit(1))), _SHIFT) != 0)
    df = df.withColumn(firsts, F.concat(F.slice(s, 1, 1), first)).drop(shingles)
    m = F.col(firsts)
    none = F.array().cast("array<int>")

    def low(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")

    # The filled bins in order, with a null for each empty bin between them.
    gap = lambda a, b: F.array_repeat(F.lit(None).cast("int"), b - a - F.lit(1))
    spread = F.flatten(
        F.transform(m, lambda x, j: F.concat(F.array(low(x)), gap(_bin(x), F.coalesce(_bin(F.get(m, j + F.lit(1))), F.lit(BINS)))))
    )
    spread = F.when(F.size(m) == BINS, F.transform(m, low)).when(F.size(m) > 0, F.concat(gap(F.lit(-1), _bin(F.get(m, F.lit(0)))), spread)).otherwise(none)
    df = df.withColumn(slots, spread)
    # Of each filled bin its number and low byte in one int.
    df = df.withColumn(filled, F.when(F.size(m) < BINS, F.transform(m, lambda x: F.shiftleft(_bin(x), LOW_BITS) + low(x))).otherwise(none))

    def borrowed(i: Column) -> Column:
        # The bin's own sequence of bins, up to the first filled one.
        tries = [F.get(F.col(slots), F.get(F.expr(f"array({places})"), i)) for places in _TRIES]
        # A bin that met none takes the filled bin that comes first in an order of all bins of its own.
        factor = (F.pmod(i.cast("long") * F.lit(1103515245) + F.lit(12345), F.lit(1 << 15)) * F.lit(2) + F.lit(1)).cast("int")
        offset = F.pmod(i * F.lit(69069) + F.lit(7), F.lit(BINS))
        low_mask, bin_mask = F.lit((1 << LOW_BITS) - 1), F.lit((BINS - 1) << LOW_BITS)

        def order(y: Column) -> Column:
            turn = (F.shiftright(y, LOW_BITS) * factor + offset) * F.lit(1 << LOW_BITS)
            return turn.bitwiseAND(bin_mask) + y.bitwiseAND(low_mask)

        return F.coalesce(*tries, F.array_min(F.transform(F.col(filled), order)).bitwiseAND(low_mask))

    dense = F.transform(F.col(slots), lambda v, i: F.coalesce(v, borrowed(i)))
    dense = F.transform(dense, lambda v: (v - F.lit(128)).cast("tinyint"))
    return df.withColumn(out, dense).drop(firsts, slots, filled)


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprint columns, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(F.col(a), F.col(b), lambda x, y: x == y), lambda e: e))
    chance = 1.0 / (1 << LOW_BITS)
    estimate = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance))
    both = (F.size(a) == 0) & (F.size(b) == 0)
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(both, F.lit(1.0)).when(either, F.lit(0.0)).otherwise(estimate)


def as_hex(fingerprint: str) -> Column:
    return F.array_join(F.transform(F.col(fingerprint), lambda v: F.lower(F.lpad(F.hex(v.cast("int") + F.lit(128)), 2, "0"))), "")


def _constants(values: list, kind: str) -> Column:
    """One constant array, however many values: the plan does not grow with them."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the rising bounds the key reaches, by binary search."""
    if not bounds:
        return F.lit(0)
    table, steps, step = _constants(bounds, "string"), [], 1
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    low = F.array(*[F.lit(s) for s in reversed(steps)])
    return F.aggregate(
        low,
        F.lit(0),
        lambda at, s: F.when((at + s <= F.lit(len(bounds))) & (F.get(table, at + s - F.lit(1)) <= key), at + s).otherwise(at),
    )


_MOST = (1 << 63) - 1


def _turned(key: int | None) -> str:
    """The key in 16 digits that rise as keys fall; G for null, which comes last."""
    return "G" if key is None else f"{(key ^ _MOST) & ((1 << 64) - 1):016X}"


def _ordered(docs: DataFrame, key: str, payload: list[str], ranges: int) -> tuple[Column, list[str]]:
    """A string that rises in the order of with_next, and the bounds of about so many ranges of it.

    It holds the key and, of keys that fill two ranges or more, the opening of the first payload column. Counted are
    at most LOOKED_AT openings a range.
    """
    own = F.col(key).cast("bigint")
    digits = F.coalesce(F.lpad(F.hex(own.bitwiseXOR(F.lit(_MOST))), 16, "0"), F.lit(_turned(None)))
    plain = F.concat(digits, F.lit(":"))
    parts = [i / ranges for i in range(1, ranges)]
    if not parts:
        return plain, []
    cuts, rows, named = docs.select(F.percentile_approx(own, _constants(parts, "double"), F.lit(10 * ranges)), F.count("*"), F.count(key)).first()
    filled = Counter(cuts or [])
    bounds = {_turned(k) + ":" for k in filled}
    if named < rows:
        filled[None] = ranges * (rows - named) // rows
        bounds.add(_turned(None) + ":")
    hot = {_turned(k): many for k, many in filled.items() if many > 1} if isinstance(docs.schema[payload[0]].dataType, StringType) else {}
    if not hot:
        return plain, sorted(bounds)
    opening = F.coalesce(F.hex(F.substring(payload[0], 1, OPENING).cast("binary")), F.lit(""))
    place = F.array_position(_constants(list(hot), "string"), digits).cast("int")
    dealt = F.pmod(F.xxhash64(payload[0]), F.get(_constants([LOOKED_AT * many for many in hot.values()], "bigint"), place - F.lit(1)))
    seen = docs.where(place > 0).groupBy(digits.alias("id"), dealt.alias("dealt")).agg(F.min_by(opening, F.xxhash64(payload[0], F.lit(1))).alias("opening"))
    openings: dict[str, list[str]] = {}
    for r in seen.collect():  # at most LOOKED_AT a range
        openings.setdefault(r["id"], []).append(r["opening"])
    for digit, some in openings.items():
        bounds.update(f"{digit}:{x}" for x in sorted(some)[LOOKED_AT::LOOKED_AT])
        bounds.add(digit + ";")
    return F.when(place > 0, F.concat(plain, opening)).otherwise(plain), sorted(bounds)


def with_next(docs: DataFrame, key: str, payload: list[str], ranges: int) -> DataFrame:
    """docs with `next_<c>` (in place of own columns of these names) for each payload column c: the value in the next row by descending key, after the last the first."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be of an integer type")
    docs = docs.drop(*[f"next_{c}" for c in payload])
    own_range, place, to, lent = unused(docs.columns, "range", "place", "to", "lent")
    order, bounds = _ordered(docs, key, payload, ranges)
    placed = docs.withColumn(place, order).withColumn(own_range, _range_of(F.col(place), bounds))
    firsts = {r[0]: r[1] for r in placed.groupBy(own_range).agg(F.min(place)).collect()}  # a row for each range
    if not firsts:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in payload])
    used = sorted(firsts)
    before = {r: used[k - 1] for k, r in enumerate(used)}
    # Ranges without a row are never asked for.
    first = F.get(_constants([firsts.get(r, "") for r in range(max(used) + 1)], "string"), F.col(own_range))
    target = F.get(_constants([before.get(r, 0) for r in range(max(used) + 1)], "int"), F.col(own_range))
    stays = F.struct(F.col(own_range).cast("int").alias("r"), F.lit(False).alias("lent"))
    goes = F.struct(target.alias("r"), F.lit(True).alias("lent"))
    dealt = placed.withColumn(to, F.explode(F.when(F.col(place) == first, F.array(stays, goes)).otherwise(F.array(stays)))).drop(place)
    dealt = dealt.withColumn(own_range, F.col(to)["r"]).withColumn(lent, F.col(to)["lent"]).drop(to)
    following = Window.partitionBy(own_range).orderBy(lent, F.col(key).desc_nulls_last(), *payload)
    dealt = dealt.select("*", *[F.lead(c).over(following).alias(f"next_{c}") for c in payload])
    return dealt.where(~F.col(lent)).drop(own_range, lent)


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Digest of operator 10: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its characters replaced by the first as many of the next document.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(with_fingerprint(own, "text", "print"), "doc_id", ["text", "print"], RANGES_PER_PARTITION * partitions)
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    own = own.withColumn("_cut", cut)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int")), F.substring("next_text", F.lit(1), F.col("_cut")))
    own = own.withColumn("edited", edited).drop("text", "next_text", "_cut")
    own = with_fingerprint(own, "edited", "edited_print")
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex("print").alias("fingerprint"),
        as_hex("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"),
    )
