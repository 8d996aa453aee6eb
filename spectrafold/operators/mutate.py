"""Changes as functions from a table and a patch to the new table (copy on write), and their publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows.select(*base.columns))


def upsert(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those with their key, or are added."""
    return base.join(rows.select(key), key, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def patch(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Fields of the changes replace those of the row with their key; null fields are skipped. Of several changes of one row each field takes its greatest value."""
    fields = [c for c in changes.columns if c != key]
    new = changes.groupBy(F.col(key).alias("_key")).agg(*[F.max(c).alias(f"_new_{c}") for c in fields])
    met = base.join(new, F.col(key) == F.col("_key"), "left")
    return met.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def soft_delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    gone = keys.select(F.col(key).alias("_key")).distinct()
    met = base.join(gone, F.col(key) == F.col("_key"), "left")
    return met.withColumn("isDelete", F.when(F.col("_key").isNotNull(), F.lit(1)).otherwise(F.col("isDelete"))).drop("_key")


def hard_delete(base: DataFrame, keys: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    return base.join(keys, list(on), "left_anti")


def apply_deltas(base: DataFrame, deltas: DataFrame, key: str = "id") -> DataFrame:
    """totalSize and totalCount moved by the sums of the deltas (key, size, count)."""
    moved = deltas.groupBy(F.col(key).alias("_key")).agg(F.sum("size").alias("_size"), F.sum("count").alias("_count"))
    met = base.join(moved, F.col(key) == F.col("_key"), "left")
    add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return met.select(*[add(c, {"totalSize": "_size", "totalCount": "_count"}[c]) if c in ("totalSize", "totalCount") else F.col(c) for c in base.columns])


def publish(df: DataFrame, path: str) -> None:
    """Write the new table beside the old one; readers take the path that they are given after the write has ended."""
    df.write.mode("errorifexists").parquet(path)
