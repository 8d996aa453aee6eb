"""Streams whose micro-batches are jobs of their own: joins with tables as they are now, and usage kept up by deltas.

Each micro-batch writes one folder that its number names. A batch that Spark repeats after a failure writes the same
folder again, so nothing counts twice. Inside a micro-batch adaptive execution splits skewed joins, which it doesn't
do for plain streaming joins. Read what comes out between runs: while a repeated batch is written its folder is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA = "id bigint, size bigint, count bigint"
USAGE = "id bigint, totalSize bigint, totalCount bigint"


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/out/batch={number}")


def run(stream: DataFrame, path: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the stream to the end of what its source has; `make` turns the rows of a micro-batch into what is written. A later run with the same path goes on."""
    spark = stream.sparkSession
    empty = make(spark.createDataFrame([], stream.schema))
    write_batch(empty, path, -1)
    writer = stream.writeStream.foreachBatch(lambda rows, number: write_batch(make(rows), path, number)).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return written(spark, path, empty.schema).drop("batch")


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches with `batch`."""
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch bigint").parquet(f"{path}/out")


def picture_deltas(changes: DataFrame) -> DataFrame:
    """DELTA of each space from picture changes (spaceId, picSize, added): partial sums before the shuffle, so a hot space is no hot task. Public pictures count for none."""
    sign = F.when(F.col("added"), 1).otherwise(-1)
    rows = changes.where(F.col("spaceId").isNotNull()).select(F.col("spaceId").cast("bigint").alias("id"), (F.coalesce("picSize", F.lit(0)).cast("bigint") * sign).alias("size"), sign.cast("bigint").alias("count"))
    return rows.groupBy("id").agg(F.sum("size").alias("size"), F.sum("count").alias("count"))


def keep_usage(changes: DataFrame, path: str) -> DataFrame:
    """Usage by space after the stream of picture changes: USAGE of every space that a change named."""
    run(changes, path, picture_deltas)
    return usage(changes.sparkSession, path)


def _kept(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The last folded usage and the number of the batch it goes up to."""
    # An empty version comes first, so that there is one to read.
    spark.createDataFrame([], USAGE).write.mode("ignore").parquet(f"{path}/kept/upto=-1")
    kept = spark.read.schema(f"{USAGE}, upto bigint").parquet(f"{path}/kept")
    last = max(int(f.rsplit("upto=", 1)[1].split("/")[0]) for f in kept.inputFiles())
    return last, kept.where(F.col("upto") == last).drop("upto")


def usage(spark: SparkSession, path: str) -> DataFrame:
    """USAGE now: what was folded, and the deltas of the batches after it."""
    last, kept = _kept(spark, path)
    moved = written(spark, path, DELTA).where(F.col("batch") > last).select("id", F.col("size").alias("totalSize"), F.col("count").alias("totalCount"))
    return kept.unionByName(moved).groupBy("id").agg(F.sum("totalSize").alias("totalSize"), F.sum("totalCount").alias("totalCount"))


def fold(spark: SparkSession, path: str) -> int:
    """Write usage now as the kept version, so that later reads add up only the batches after it. Run it between runs of the stream; a repeated fold changes nothing."""
    last, _ = _kept(spark, path)
    upto = written(spark, path, DELTA).agg(F.max("batch")).first()[0]
    if upto is None or upto <= last:
        return last
    usage(spark, path).write.mode("overwrite").parquet(f"{path}/kept/upto={upto}")
    return upto
