"""Tables and files in the folder that every executor and the driver share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, one machine alone may use a temporary folder; a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.spectrafold.sharedDir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spectrafold-")
        spark.conf.set("spark.spectrafold.sharedDir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*kept: DataFrame) -> None:
    """Delete what keep() wrote once nothing reads it any more."""
    for df in kept:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the columns, in either case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, also where body asks for it inside the lambda of an array function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of an array that are summed up one after the other.
RUN = 64


def sums_before(values: Column, levels: int = 2) -> Column:
    """For each element of an array of longs, the sum of those before it.

    aggregate copies its state at every step, so a list must not grow in it: runs of RUN elements are summed, then the
    runs' sums in the same way, `levels` times, and what is left (one of 4096 elements) one after the other.
    """

    def plain(part: Column, begin: Column) -> Column:
        start = F.struct(begin.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    if not levels:
        return plain(values, F.lit(0))

    def of(values: Column) -> Column:
        run = lambda i: F.slice(values, i * RUN + 1, F.lit(RUN))
        total = lambda i: F.aggregate(run(i), F.lit(0).cast("long"), lambda a, x: a + x)
        sums = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(values), F.lit(RUN)).cast("int")), total)
        return F.flatten(F.transform(sums_before(sums, levels - 1), lambda begin, i: plain(run(i), begin)))

    return let(values, of)


#: Characters of a page of a text.
PAGE = 4096


def pages(text: Column) -> Column:
    """The text in parts of PAGE characters, for `cut_out`."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PAGE), F.lit(0))


def cut_out(paged: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive, at least one) of a paged text: walks over the pages concerned, not over the text from its start."""
    first = F.call_function("div", start, F.lit(PAGE)).cast("int")
    last = F.call_function("div", end - F.lit(1), F.lit(PAGE)).cast("int")
    return F.substring(F.array_join(F.slice(paged, first + 1, last - first + 1), ""), start - first * PAGE + 1, end - start)


def schema_with(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df with further columns behind its own."""
    out = StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


#: Bytes of texts that travel to a Python worker in one Arrow batch, where the session says nothing of it; one longer text makes a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold about BATCH_BYTES at most, unless it has a bound of its own.

    Spark's default is 10,000 rows or 64 MB, which the JVM (in buffers that grow by doubling) and the worker hold for
    each task, and of which workers, living from task to task, keep much. The setting stays, since Spark reads it when
    a table is written, not when it is described.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows of an Arrow batch that a task turns into Python values at once.
PART_ROWS = 1024


def parts(batches: Iterable[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def array_parts(arrays: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """The same of the arrays that an Arrow function gets, which gives back as many values in as many arrays as it likes."""
    for array in arrays:
        yield from (array.slice(at, PART_ROWS) for at in range(0, len(array), PART_ROWS))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column `name`, 0, 1, .. in this order, as a table.

    Rows are dealt by ranges of the order and sorted there; a row's number is its place in the range and the rows of
    the ranges before it. The window sees one row a range.
    """
    part, many, before, place = unused([*df.columns, name], "part", "many", "before", "place")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    placed = keep(placed, f"numbered-{name}").withColumn(part, F.shiftright(place, 33))
    sizes = placed.groupBy(part).agg(F.count("*").alias(many))
    ahead = F.sum(many).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(ahead, F.lit(0)).alias(before))
    row = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(before) + row).drop(part, before, place)
