"""Line dedup by content-defined chunks (operator 7, DataFrame functions only).

A rolling hash over the hashes of each two neighbouring lines chooses where
chunks end: after a line whose pair hash is even, if that of the line before is
not. So a boundary depends on three lines only, and chunks meet again soon after
lines are put in or taken out; all but the last hold two lines or more. A chunk
of two lines or more whose hash occurs more than once in the corpus is compared
byte by byte with its first occurrence (least id, then text hash, then place) and
removed if it is equal; the first occurrence stays. What is left of a text is
joined again by line feeds.

Chunks miss passages that hold no whole common chunk, so with `runs` (as the
registered query and the pipeline ask) each two neighbouring lines and each line
of RUN_WORDS words are looked up and compared in the same way. Later copies that
share a line grow together to the whole shared run; a run goes if it holds a
chunk or such a line that is a later copy, or RUN_WORDS words in all. So every
whole-line passage of RUN_WORDS words that stands earlier in the corpus goes. The
pairs of a run may stand in different earlier texts; the first occurrence of a
line in the order above always stays, as a later copy needs an earlier one.

Scale: chunks are counted as narrow rows with partial sums, so a chunk that a
third of all texts hold is one row a task. Only texts of repeated chunks leave
their documents, once. Texts are joined twice with the decisions about them, by
the document's key, by a merge join at every size, since the decisions grow with
the corpus; a key's decisions are sets, bounded by its own lines.

A null text stays null and an empty one empty. Rows that are equal in id and
text are one document in several rows: they lose the same chunks. Null ids come
first. Extra columns are kept, under any name but that of the added one. An empty table gives no rows. A text all of whose
chunks occur before becomes empty; no row is dropped. A very long text is one
row; its chunks are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, let, unused

#: A chunk is looked up from this many lines on.
LEAST_LINES = 2
#: A shared run without a repeated chunk goes from this many words on, be it one line.
RUN_WORDS = 50


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def chunks(h: Column) -> Column:
    """array<struct<start, end>> of the chunks of a column of line hashes; end is exclusive."""

    def even(i: Column) -> Column:
        # Hash of the window of two lines that ends at line i.
        before, here = F.get(h, i - F.lit(1)), F.get(h, i)
        rolled = F.shiftleft(before, 1).bitwiseXOR(F.shiftrightunsigned(before, 63)).bitwiseXOR(here)
        return F.xxhash64(rolled).bitwiseAND(F.lit(1)) == 0

    n = F.size(h)
    inner = F.filter(F.sequence(F.lit(0), n - F.lit(1)), lambda i: (i >= 1) & (i < n - F.lit(1)) & even(i) & ((i == 1) | ~even(i - F.lit(1))))
    ends = F.concat(F.transform(inner, lambda i: i + F.lit(1)), F.array(n))
    ranges = lambda ends: F.zip_with(F.concat(F.array(F.lit(0)), ends), ends, lambda a, e: F.struct(a.alias("start"), e.alias("end")))
    return F.filter(let(ends, ranges), lambda c: c["end"].isNotNull())


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.withColumn("_a", F.xxhash64(text)).withColumn("_b", F.xxhash64(key)).withColumn("_lines", lines_of(F.col(text)))


def words_of(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+"))


def _chunk_rows(docs: DataFrame, text: str, key: str, runs: bool) -> DataFrame:
    """_a, _b, id, start, end, seed, hash of every chunk of LEAST_LINES lines or more; with `runs` also of the lines of RUN_WORDS words and, not as seeds, of the other pairs of lines."""
    long = F.length(F.col(text)) >= 2 * RUN_WORDS - 1
    rows = docs.select(F.col(key), F.col(text)).where((F.instr(F.col(text), "\n") > 0) | (long if runs else F.lit(False)))
    rows = _keyed(rows, text, key).withColumn("_h", line_hashes(F.col("_lines")))
    if runs:
        # RUN_WORDS words take 2 * RUN_WORDS - 1 characters.
        wordy = F.transform("_lines", lambda x, i: F.when((F.length(x) >= 2 * RUN_WORDS - 1) & (words_of(x) >= RUN_WORDS), i))
        rows = rows.withColumn("_long", F.filter(wordy, lambda i: i.isNotNull()))
    rows = rows.withColumn("_c", F.filter(chunks(F.col("_h")), lambda c: c["end"] - c["start"] >= LEAST_LINES))
    unit = lambda start, end, seed: F.struct(start.alias("start"), end.alias("end"), F.lit(seed).alias("seed"), F.xxhash64(F.slice(F.col("_h"), start + 1, end - start)).alias("hash"))
    units = F.transform("_c", lambda c: unit(c["start"], c["end"], True))
    if runs:
        twos = F.transform(F.filter("_c", lambda c: c["end"] - c["start"] == 2), lambda c: c["start"])
        starts = F.when(F.size("_h") >= 2, F.sequence(F.lit(0), F.size("_h") - F.lit(2))).otherwise(F.array().cast("array<int>"))
        units = F.concat(units, F.transform("_long", lambda i: unit(i, i + 1, True)), F.transform(F.array_except(starts, twos), lambda i: unit(i, i + 2, False)))
    return rows.select("_a", "_b", F.col(key).alias("id"), F.explode(units).alias("c")).select("_a", "_b", "id", "c.start", "c.end", "c.seed", "c.hash")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", runs: bool = False) -> DataFrame:
    """_a, _b (the document's key) and start, end of every chunk that is a later copy, byte for byte; with `runs`, of every run that goes."""
    every = keep(_chunk_rows(docs, text, key, runs), "chunks")
    first = F.struct("id", "_a", "start")
    again = every.groupBy("hash").agg(F.count("*").alias("n"), F.min(first).alias("first")).where("n > 1").select("hash", "first")
    again = keep(again, "repeated-chunks")
    met = every.join(again, "hash").select("_a", "_b", "start", "end", "seed", "hash", first.eqNullSafe(F.col("first")).alias("is_first"))
    asked = met.groupBy("_a", "_b").agg(F.collect_set(F.struct("hash", "start", "end", "seed", "is_first")).alias("asked"))
    rows = _keyed(docs.select(F.col(key), F.col(text)), text, key).select("_a", "_b", "_lines").join(asked.hint("merge"), ["_a", "_b"])
    piece = lambda c: F.array_join(F.slice(F.col("_lines"), c["start"] + 1, c["end"] - c["start"]), "\n")
    cut = F.transform("asked", lambda c: F.struct(c["hash"].alias("hash"), c["start"].alias("start"), c["end"].alias("end"), c["seed"].alias("seed"), c["is_first"].alias("is_first"), piece(c).alias("bytes")))
    cut = keep(rows.select("_a", "_b", F.explode(cut).alias("c")).select("_a", "_b", "c.*"), "chunk-bytes")
    model = keep(cut.where("is_first").groupBy("hash").agg(F.first("bytes").alias("model")), "first-chunks")
    later = cut.where("not is_first").join(model, "hash").where(F.col("bytes") == F.col("model"))
    if not runs:
        return later.select("_a", "_b", "start", "end")
    head = F.when(~F.col("seed"), words_of(F.substring_index("bytes", "\n", 1)))
    tail = F.when(~F.col("seed"), words_of(F.substring_index("bytes", "\n", -1)))
    return _grown(later.select("_a", "_b", "start", "end", "seed", head.alias("head"), tail.alias("tail")).distinct())


def _grown(later: DataFrame) -> DataFrame:
    """_a, _b, start, end of the runs that later copies with a line in common make, of those that hold a seed or RUN_WORDS words.

    Without a seed a run is pairs that start at one line after the other: the words of their first lines and of the last line are its own.
    """
    order = Window.partitionBy("_a", "_b").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("start") >= reached)).cast("int")
    run = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.struct("start", "tail"))["tail"]
    runs = later.withColumn("opens", opens).withColumn("run", run).groupBy("_a", "_b", "run")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("seed").alias("seed"), (F.sum("head") + last).alias("words"))
    return runs.where(F.col("seed") | (F.col("words") >= RUN_WORDS)).select("_a", "_b", "start", "end")


def _without(lines: Column, ranges: Column) -> Column:
    """The lines outside of the ranges, which do not overlap: what lies between each range and the next, in order."""
    begins = F.concat(F.array(F.lit(0)), F.transform(F.array_sort(ranges), lambda r: r["end"]))
    ends = F.concat(F.transform(F.array_sort(ranges), lambda r: r["start"]), F.array(F.size(lines)))
    between = F.zip_with(begins, ends, lambda a, e: F.struct(a.alias("start"), e.alias("end")))
    return let(lines, lambda x: F.flatten(F.transform(between, lambda g: F.slice(x, g["start"] + 1, g["end"] - g["start"]))))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", runs: bool = False, removed: str = "removed") -> DataFrame:
    """docs with later copies of chunks, or with `runs` of whole shared runs, cut out of the text, and a column `removed`, the cut ranges of lines (null where none)."""
    docs = docs.drop(removed)
    a, b = unused([*docs.columns, removed], "_a", "_b")
    gone = repeats(docs.select(key, text), text, key, runs).groupBy("_a", "_b").agg(F.collect_set(F.struct("start", "end")).alias(removed))
    gone = keep(gone, "removed").withColumnsRenamed({"_a": a, "_b": b})
    whole = docs.withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(key)).join(gone.hint("merge"), [a, b], "left").drop(a, b)
    return whole.withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(F.array_join(_without(lines_of(F.col(text)), F.col(removed)), "\n")))


def dedup_documents(docs: DataFrame, runs: bool = False) -> DataFrame:
    """Digest of operator 7: doc_id, n_lines, n_removed (lines), n_chunks_removed (with `runs`, runs), removed (start:end of the cut ranges), kept_chars, kept_sha256."""
    out = dedup(docs.select("doc_id", "text").withColumn("n_lines", F.coalesce(F.size(lines_of(F.col("text"))), F.lit(0))), runs=runs)
    ranges = F.array_sort(F.coalesce(F.col("removed"), F.array().cast("array<struct<start:int,end:int>>")))
    return out.select(
        "doc_id",
        F.greatest(F.col("n_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.size(ranges).cast("long").alias("n_chunks_removed"),
        F.array_join(F.transform(ranges, lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
