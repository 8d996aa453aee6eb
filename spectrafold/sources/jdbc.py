"""Tables of a database over JDBC: read in ranges of a numeric key by many tasks, filters and columns pushed down."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task reads, if keys are spread evenly.
ROWS = 1_000_000
#: Connections that a scan opens at most; tasks beyond it would only wait for the database.
CONNECTIONS = 64
FETCH = 10_000


def _quoted(name: str) -> str:
    if '"' in name:
        raise ValueError(f"a name with quotes: {name}")
    return f'"{name}"'


def scan(spark: SparkSession, url: str, table: str, key: str, driver: str, properties: Mapping[str, str] | None = None, rows: int = ROWS, quote=_quoted) -> DataFrame:
    """The table in ranges of `key`, between its least and greatest value; null keys come with the first range.

    The database counts and finds the bounds. Keys that lie in few places make uneven ranges; every row comes in any case.
    """
    options = {"fetchsize": str(FETCH), "driver": driver, **(properties or {})}
    k = quote(key)
    ends = spark.read.jdbc(url, f"(select min({k}) as lo, max({k}) as hi, count(*) as n from {table}) ends", properties=options).first()
    low, high, number = (ends[0], ends[1], ends[2])
    parts = min(CONNECTIONS, -(-number // rows))
    if low is None or parts <= 1:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=options)


def append(rows: DataFrame, url: str, table: str, driver: str, properties: Mapping[str, str] | None = None) -> None:
    """Add rows to the table, by at most CONNECTIONS tasks. A repeated task may add its rows again unless the table's key forbids it."""
    rows.coalesce(CONNECTIONS).write.jdbc(url, table, mode="append", properties={"driver": driver, "batchsize": str(FETCH), **(properties or {})})
