"""Sorted pages with a total, and the guard on page sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from spectrafold.sources.folders import shared_folder

PUBLIC_LIMIT = 20


@dataclass(frozen=True)
class Page:
    current: int = 1
    size: int = 10
    sort_field: str | None = None
    sort_order: str = "descend"


def guard(page: Page, limit: int = PUBLIC_LIMIT) -> Page:
    """Public lists refuse larger pages; the lists of administrators do not call this."""
    if page.size > limit:
        raise ValueError(f"page size {page.size} is over {limit}")
    return page


def ordered(df: DataFrame, page: Page, key: str = "id"):
    """Sort columns: the field, if it is one of the table's, then the key, so that ties have an order."""
    if not page.sort_field:
        return [F.col(key)]
    if page.sort_field not in df.columns:
        raise ValueError(f"cannot sort by {page.sort_field}")
    field = F.col(page.sort_field)
    return [field.asc_nulls_first() if page.sort_order == "ascend" else field.desc_nulls_last(), F.col(key)]


def records(df: DataFrame, page: Page, key: str = "id") -> DataFrame:
    """The rows of one page, by a sort that keeps no more than the pages up to it."""
    return df.orderBy(*ordered(df, page, key)).offset((page.current - 1) * page.size).limit(page.size)


def first_of_each(df: DataFrame, group: str, page: Page, key: str = "id") -> DataFrame:
    """The first page of each group. Rows beyond it are dropped before they are shuffled, so a hot group stays small."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*ordered(df, page, key)))
    return df.withColumn("_n", n).where(F.col("_n") <= page.size).drop("_n")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def one(df: DataFrame) -> DataFrame:
    """The only row of df, or none; more than one is an error when the row is read. Partial aggregates: no task gets all rows."""
    found = df.agg(F.count("*").alias("n"), F.first(F.struct("*")).alias("row"))
    many = F.raise_error(F.lit("expected one row at most, found more")).cast("bigint")
    return found.where(F.when(F.col("n") > 1, many).otherwise(F.col("n")) == 1).select("row.*")


def _table(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deep(df: DataFrame, page: Page, key: str = "id") -> DataFrame:
    """The rows of a page far behind the first: as `records`, but no task keeps the rows before it.

    Rows are dealt by ranges of the order; the ranges' counts, one number each, say in which of them the page lies, and
    only these are sorted. Rows that are equal in the whole order share a range: the key keeps ranges small.
    """
    order, first = ordered(df, page, key), (page.current - 1) * page.size
    placed = _table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_range").count().orderBy("_range").collect()
    before, asked, ahead = 0, [], 0
    for r in counts:
        if before + r["count"] > first and before < first + page.size:
            asked.append(r["_range"])
            ahead = before if len(asked) == 1 else ahead
        before += r["count"]
    return placed.where(F.col("_range").isin(asked)).orderBy(*order).offset(first - ahead).limit(page.size).drop("_range")


def page_and_total(df: DataFrame, page: Page, key: str = "id") -> DataFrame:
    """The rows of one page with `total`, the rows of all pages, counted as they pass: df is read once."""
    seen = Observation("page")
    rows = _table(records(df.observe(seen, F.count(F.lit(1)).alias("total")), page, key), "page")
    return rows.withColumn("total", F.lit(seen.get["total"]).cast("bigint"))
