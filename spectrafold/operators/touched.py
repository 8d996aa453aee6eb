"""Tables laid out in folders by the hash of their key, so that a change reads and writes only the folders of its keys.

A folder is one task's work: take so many folders that one fits an executor. A change that fails before its commit leaves
the table as it was; during the commit folders change one after the other (plain Parquet has no transactions), so
read between changes, and make one change at a time. A repeated change gives the same rows. Null keys have a folder too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import mutate

FOLDER = "_folder"


def folder_of(key: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(folders)).cast("int")


def _write(rows: DataFrame, path: str, key: str, folders: int) -> None:
    placed = rows.withColumn(FOLDER, folder_of(key, folders)).repartition(FOLDER)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(path)


def lay_out(rows: DataFrame, path: str, key: str, folders: int) -> None:
    """Write the table below a new path."""
    _write(rows, path, key, folders)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


class _Files:
    """The folders of a table as its file system has them."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._home = path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: int) -> set[str]:
        at = self._path(f"{self._home}/{FOLDER}={folder}")
        return {f.getPath().getName() for f in self._fs.listStatus(at)} if self._fs.exists(at) else set()

    def drop(self, folder: int) -> None:
        self._fs.delete(self._path(f"{self._home}/{FOLDER}={folder}"), True)


def change(path: str, schema: StructType, key: str, folders: int, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the folders of `keys` by what `make` turns their rows into; gives the numbers of these folders.

    `make` keeps the keys of rows or drops rows, and adds rows only with keys of `keys`.
    """
    spark = keys.sparkSession
    # At most as many numbers as there are folders.
    touched = sorted(r[0] for r in keys.select(folder_of(key, folders).alias(FOLDER)).distinct().collect())
    files = _Files(spark, path)
    before = {n: files.names(n) for n in touched}
    there = [f"{path}/{FOLDER}={n}" for n in touched if before[n]]
    old = spark.read.schema(schema).option("basePath", path).parquet(*there).select(*schema.names) if there else spark.createDataFrame([], schema)
    _write(make(old).select(*schema.names), path, key, folders)
    for n in touched:
        # A folder without rows is not written, so its old files would stay.
        if before[n] and files.names(n) == before[n]:
            files.drop(n)
    return touched


def patch(path: str, schema: StructType, changes: DataFrame, folders: int, key: str = "id") -> list[int]:
    return change(path, schema, key, folders, changes, lambda rows: mutate.patch(rows, changes, key))


def upsert(path: str, schema: StructType, rows: DataFrame, folders: int, key: str = "id") -> list[int]:
    return change(path, schema, key, folders, rows, lambda old: mutate.upsert(old, rows, key))


def soft_delete(path: str, schema: StructType, keys: DataFrame, folders: int, key: str = "id") -> list[int]:
    return change(path, schema, key, folders, keys, lambda rows: mutate.soft_delete(rows, keys, key))


def hard_delete(path: str, schema: StructType, keys: DataFrame, folders: int, key: str = "id") -> list[int]:
    return change(path, schema, key, folders, keys, lambda rows: mutate.hard_delete(rows, keys, (key,)))
