"""Requests of one batch that see each other: quotas used up in order, and claims of which the first wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafold.sources.folders import shared_folder

from . import rules
from .rules import NO_AUTH, NOT_FOUND, OK, OPERATION, PARAMS, first_error


def _table(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sums_before(rows: DataFrame, key: str, order: str, sums: Mapping[str, str]) -> DataFrame:
    """rows with, for each new name in `sums`, the sum of the named column over the rows of the same key that come before in the order.

    Rows are dealt by ranges of key and order, so a hot key spreads over many ranges; each range carries the sums of the
    ranges of the same key before it. A window sees the rows of one range, or one row for each range of a key. `order`
    has no ties within a key; null keys are one key.
    """
    placed = rows.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id())
    placed = _table(placed, "ordered")
    own = Window.partitionBy("_range", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    of_range = placed.groupBy(F.col("_range").alias("_of"), F.col(key).alias("_key")).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    carried = of_range.select("_of", "_key", *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = placed.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    met = inside.join(carried, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return met.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", "_of", "_key", *[f"_{n}" for n in sums])


def upload_admissions(asks: DataFrame, spaces: DataFrame, pictures: DataFrame, order: str) -> DataFrame:
    """Uploads (asker, asker_admin, spaceId, pictureId, picSize) of one batch with `code`, each decided in the state that those before it leave.

    spaces: live ones with usage and quotas. An upload is let in while count and size are below the quota, so the last
    one may go over it. Usage never falls within a batch, so once a quota is reached it stays so: an upload finds room
    if and only if the usage and the sizes of all sound uploads before it are below the quota, let in or not. The quota
    is asked after the space and its owner, and before the picture to replace. Adds totalCount and totalSize of the
    space that the picture would go to, as the upload finds them (null for public pictures).
    """
    space = spaces.select(F.col("id").alias("_space"), F.col("userId").alias("_owner"), F.col("totalCount").alias("_count0"), F.col("totalSize").alias("_size0"), "maxCount", "maxSize")
    told = rules.upload_decisions(asks.withColumn("_asked", F.col("spaceId")), unlimited(spaces), pictures, F.lit(None).cast("string"))
    told = told.withColumnRenamed("code", "_code").withColumnRenamed("spaceId", "_to")
    placed = sums_before(told.where(F.col("_to").isNotNull()), "_to", order, {"_count": "countDelta", "_bytes": "sizeDelta"})
    met = placed.join(space, F.col("_to") == F.col("_space"), "left")
    met = met.withColumn("totalCount", F.col("_count0") + F.col("_count")).withColumn("totalSize", F.col("_size0") + F.col("_bytes"))
    asked = F.col("_asked").isNotNull()
    early = first_error((asked & F.col("_space").isNull(), NOT_FOUND), (asked & (F.col("_owner") != F.col("asker")), NO_AUTH), (asked & (F.col("totalCount") >= F.col("maxCount")), OPERATION), (asked & (F.col("totalSize") >= F.col("maxSize")), OPERATION))
    met = met.withColumn("code", F.when(early != OK, early).otherwise(F.col("_code")))
    public = told.where(F.col("_to").isNull()).withColumn("code", F.col("_code")).withColumn("totalCount", F.lit(None).cast("bigint")).withColumn("totalSize", F.lit(None).cast("bigint"))
    columns = [*[c for c in asks.columns if c != "spaceId"], F.col("_asked").alias("spaceId"), "code", "totalCount", "totalSize"]
    return met.select(*columns).unionByName(public.select(*columns))


def unlimited(spaces: DataFrame) -> DataFrame:
    """spaces whose quotas nothing reaches, to see what the other rules say."""
    most, none = F.lit((1 << 63) - 1), F.lit(0).cast("bigint")
    return spaces.withColumns({"maxCount": most, "maxSize": most, "totalCount": none, "totalSize": none})


def first_claims(rows: DataFrame, keys: Sequence[str], order: str, sound: Column, code: int) -> DataFrame:
    """rows whose `code` is set to `code` for sound rows that claim a key after another sound row; `order` has no ties.

    The least order of each key is a partial aggregate; no window holds the rows of a key.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    first = rows.where(sound).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(order).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    on = same[0]
    for more in same[1:]:
        on &= more
    met = rows.join(first, on, "left")
    return met.withColumn("code", F.when(sound & (F.col(order) != F.col("_first")), F.lit(code)).otherwise(F.col("code"))).drop("_first", *names)


def registrations(rows: DataFrame, users: DataFrame, order: str) -> DataFrame:
    """register_errors of rows (account, password, again) of one batch: of those that are sound, the first takes an account."""
    told = rules.register_errors(rows, users).withColumn("_account", F.lower("account"))
    return first_claims(told, ["_account"], order, F.col("code") == OK, PARAMS).drop("_account")


def new_spaces(asks: DataFrame, spaces: DataFrame, order: str) -> DataFrame:
    """new_space_errors of asks (asker, asker_admin, spaceLevel, spaceType) of one batch: a user's first sound ask for a type gets the space."""
    return first_claims(rules.new_space_errors(asks, spaces), ["asker", "spaceType"], order, F.col("code") == OK, OPERATION)


def team_admins(asks: DataFrame, ids: Column) -> DataFrame:
    """spaceId, userId, spaceRole: the membership that comes with every new team space; asks: what new_spaces gives."""
    return asks.where((F.col("code") == OK) & (F.col("spaceType") == 1)).select(ids.alias("spaceId"), F.col("asker").alias("userId"), F.lit("admin").alias("spaceRole"))
