"""Ids for new rows: time in the high bits, the row's place in the low ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .admission import sums_before

#: Milliseconds at which ids begin: 2020-01-01 UTC.
EPOCH = 1_577_836_800_000
BITS = 22


def first_id(now: int) -> int:
    """The least id given at `now` (milliseconds)."""
    if now < EPOCH:
        raise ValueError("ids begin in 2020")
    return (now - EPOCH) << BITS


def next_free(now: int, rows: int) -> int:
    """The first millisecond at which other ids may be given after `rows` of them at `now`: 2^22 fit one."""
    return now + 1 + max(rows - 1, 0) // (1 << BITS)


def assigned(rows: DataFrame, order: str, now: int, name: str = "id") -> DataFrame:
    """rows with new ids that rise with `order`, which has neither ties nor nulls.

    The place of a row is its rank by `order` over ranges with carried counts: the same whatever partition holds the row
    and whenever a task is repeated, so a row that is written again has the id that it had.
    """
    placed = sums_before(rows.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)), "_all", order, {"_place": "_one"})
    return placed.withColumn(name, F.lit(first_id(now)) + F.col("_place")).drop("_all", "_one", "_place")
