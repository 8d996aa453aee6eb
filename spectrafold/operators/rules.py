"""Quota, review and validation rules; validation gives an error code and never raises for a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.sources.catalogue import PASS, PENDING, REJECT, ROLES

from .predicates import live, outer_key

# Fixed values.
OK, PARAMS, NO_AUTH, NOT_FOUND, OPERATION = 0, 40000, 40101, 40400, 50001
FORMATS = ("jpeg", "jpg", "png", "webp")
CONTENT_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
MAX_FILE = 2 * 1024 * 1024
MAX_NAME, MAX_URL, LEAST_ACCOUNT = 30, 1024, 2


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c) == "")


def first_error(*rules: tuple[Column, int]) -> Column:
    """The code of the first rule that is broken, or OK."""
    out = F.lit(OK)
    for broken, code in reversed(rules):
        out = F.when(broken, F.lit(code)).otherwise(out)
    return out


def usage(pictures: DataFrame) -> DataFrame:
    """Sum of sizes and number of live pictures of each space."""
    return live(pictures).where(F.col("spaceId").isNotNull()).groupBy("spaceId").agg(F.sum("picSize").alias("totalSize"), F.count("*").alias("totalCount"))


def with_usage(spaces: DataFrame, used: DataFrame) -> DataFrame:
    met = spaces.join(used.withColumnRenamed("spaceId", "_s"), F.col("id") == F.col("_s"), "left").drop("_s")
    return met.withColumn("totalSize", F.coalesce("totalSize", F.lit(0))).withColumn("totalCount", F.coalesce("totalCount", F.lit(0)))


def quota_error() -> Column:
    return first_error((F.col("totalCount") >= F.col("maxCount"), OPERATION), (F.col("totalSize") >= F.col("maxSize"), OPERATION))


def review_defaults() -> dict[str, Column]:
    """reviewStatus and reviewMessage of a new picture by the columns asker_admin and spaceId."""
    public = F.col("spaceId").isNull()
    return {
        "newStatus": F.when(public & ~F.col("asker_admin"), F.lit(PENDING)).otherwise(F.lit(PASS)),
        "newMessage": F.when(public & F.col("asker_admin"), F.lit("管理员自动过审")).when(public, F.lit("公共空间，待审核")).otherwise(F.concat(F.lit("私有空间自动过审_spaceId="), "spaceId")),
    }


def review_error(current: Column, target: Column) -> Column:
    """A review sets pass or reject, and not what is set already."""
    return first_error((target.isNull() | ~target.isin(PASS, REJECT), PARAMS), (current.isNull(), NOT_FOUND), (current == target, PARAMS))


def reviewed(pictures: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """pictures with reviewStatus, reviewMessage, reviewerId and reviewTime of the decisions (id, status, message, reviewer) that hold no error, and `code` of those with a decision."""
    new = decisions.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("message").alias("_message"), F.col("reviewer").alias("_reviewer"))
    met = pictures.join(new, F.col("id") == F.col("_id"), "left").withColumn("code", F.when(F.col("_id").isNotNull(), review_error(F.col("reviewStatus"), F.col("_status"))))
    good = F.coalesce(F.col("code") == OK, F.lit(False))
    stamped = {"reviewStatus": F.col("_status"), "reviewMessage": F.col("_message"), "reviewerId": F.col("_reviewer"), "reviewTime": at}
    old = {c: F.col(c) if c in pictures.columns else F.lit(None) for c in stamped}
    return met.withColumns({c: F.when(good, new).otherwise(old[c]) for c, new in stamped.items()}).drop("_id", "_status", "_message", "_reviewer")


def upload_decisions(asks: DataFrame, spaces: DataFrame, pictures: DataFrame, at: Column) -> DataFrame:
    """Uploads (asker, asker_admin, spaceId, pictureId, picSize) as they would be stored.

    spaces: live ones with usage and quotas. Adds code (0 or the first error: space, its owner, its quota, the picture to
    replace, its owner, its space), action (insert or replace), the space that the picture goes to, prefix of its path,
    editTime of a replacement, status and message of the review, and what the usage of the space grows by.
    """
    space = spaces.select(F.col("id").alias("_space"), F.col("userId").alias("_space_owner"), "totalCount", "totalSize", "maxCount", "maxSize")
    old = live(pictures).select(F.col("id").alias("_old"), F.col("userId").alias("_old_owner"), F.col("spaceId").alias("_old_space"))
    met = asks.withColumn("_s", outer_key("spaceId", asks)).withColumn("_p", outer_key("pictureId", asks))
    met = met.join(space, F.col("_s") == F.col("_space"), "left").join(old, F.col("_p") == F.col("_old"), "left")
    placed, replaces = F.col("spaceId").isNotNull(), F.col("pictureId").isNotNull()
    code = first_error(
        (placed & F.col("_space").isNull(), NOT_FOUND),
        (placed & (F.col("_space_owner") != F.col("asker")), NO_AUTH),
        (placed & (F.col("totalCount") >= F.col("maxCount")), OPERATION),
        (placed & (F.col("totalSize") >= F.col("maxSize")), OPERATION),
        (replaces & F.col("_old").isNull(), NOT_FOUND),
        (replaces & (F.col("_old_owner") != F.col("asker")) & ~F.col("asker_admin"), NO_AUTH),
        (replaces & placed & ~F.col("spaceId").eqNullSafe(F.col("_old_space")), PARAMS),
    )
    met = met.withColumn("code", code).withColumn("spaceId", F.coalesce("spaceId", "_old_space"))
    met = met.withColumn("action", F.when(replaces, F.lit("replace")).otherwise(F.lit("insert")))
    met = met.withColumn("prefix", F.when(F.col("spaceId").isNull(), F.concat(F.lit("public/"), "asker")).otherwise(F.concat(F.lit("space/"), "spaceId")))
    met = met.withColumn("editTime", F.when(replaces, at)).withColumns(review_defaults())
    grows = (F.col("code") == OK) & F.col("spaceId").isNotNull()
    met = met.withColumn("sizeDelta", F.when(grows, F.col("picSize")).otherwise(F.lit(0)).cast("bigint")).withColumn("countDelta", F.when(grows, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return met.drop("_s", "_p", *[c for c in space.columns], *old.columns)


def space_error(add: bool) -> Column:
    name, level, kind = F.col("spaceName"), F.col("spaceLevel"), F.col("spaceType")
    needed = [(blank(name), PARAMS), (level.isNull(), PARAMS), (kind.isNull(), PARAMS)] if add else []
    return first_error(*needed, (level.isNotNull() & ~level.isin(0, 1, 2), PARAMS), (~blank(name) & (F.char_length(name) > MAX_NAME), PARAMS), (kind.isNotNull() & ~kind.isin(0, 1), PARAMS))


def space_defaults() -> dict[str, Column]:
    """Name, level and type of a new space where they are not given."""
    return {
        "spaceName": F.when(blank("spaceName"), F.lit("默认空间")).otherwise(F.col("spaceName")),
        "spaceLevel": F.coalesce("spaceLevel", F.lit(0)),
        "spaceType": F.coalesce("spaceType", F.lit(0)),
    }


def role_error() -> Column:
    """What a change of a membership is checked for."""
    return first_error((F.col("spaceRole").isNotNull() & ~F.col("spaceRole").isin(*[r for r, _ in ROLES]), PARAMS))


def member_errors(rows: DataFrame, users: DataFrame, spaces: DataFrame, add: bool = True) -> DataFrame:
    """rows (spaceId, userId, spaceRole) with `code`; without `add`, of a change, only the role is checked."""
    if not add:
        return rows.withColumn("code", role_error())
    user = live(users).select(F.col("id").alias("_u"))
    space = live(spaces).select(F.col("id").alias("_s"))
    met = rows.join(user, F.col("userId") == F.col("_u"), "left").join(space, F.col("spaceId") == F.col("_s"), "left")
    code = first_error(
        (F.col("spaceId").isNull() | F.col("userId").isNull(), PARAMS),
        (F.col("_u").isNull(), NOT_FOUND),
        (F.col("_s").isNull(), NOT_FOUND),
        (F.col("spaceRole").isNotNull() & ~F.col("spaceRole").isin(*[r for r, _ in ROLES]), PARAMS),
    )
    return met.withColumn("code", code).drop("_u", "_s")


def picture_error() -> Column:
    return first_error((F.col("id").isNull(), NOT_FOUND), (~blank("url") & (F.char_length("url") > MAX_URL), PARAMS))


def upload_error(size: Column, suffix: Column) -> Column:
    return first_error((size > MAX_FILE, PARAMS), (suffix.isNull() | ~suffix.isin(*FORMATS), PARAMS))


def url_error(url: Column, status: Column, content_type: Column, content_length: Column) -> Column:
    """By the outcome of a HEAD request; another status than 200 is let through."""
    length = content_length.try_cast("bigint")
    answered = status == 200
    return first_error(
        (blank(url), NOT_FOUND),
        (~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), PARAMS),
        (~(url.startswith("http://") | url.startswith("https://")), PARAMS),
        (answered & ~blank(content_type) & ~F.lower(content_type).isin(*CONTENT_TYPES), PARAMS),
        (answered & ~blank(content_length) & length.isNull(), PARAMS),
        (answered & ~blank(content_length) & (length > MAX_FILE), PARAMS),
    )


def register_errors(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows (account, password, again) with `code`; an account of a live user is taken."""
    taken = live(users).select(F.lower("userAccount").alias("_taken")).distinct()
    met = rows.join(taken, F.lower("account") == F.col("_taken"), "left")
    code = first_error(
        (blank("account") & blank("password") & blank("again"), PARAMS),
        (F.char_length("account") < LEAST_ACCOUNT, PARAMS),
        ((F.char_length("password") < LEAST_ACCOUNT) | (F.char_length("again") < LEAST_ACCOUNT), PARAMS),
        (F.col("password") != F.col("again"), PARAMS),
        (F.col("_taken").isNotNull(), PARAMS),
    )
    return met.withColumn("code", code).drop("_taken")


def new_space_errors(asks: DataFrame, spaces: DataFrame) -> DataFrame:
    """asks (asker, asker_admin, spaceLevel, spaceType) with `code`: one space for each user and type, higher levels for administrators; defaults come first."""
    asks = asks.withColumn("spaceLevel", F.coalesce("spaceLevel", F.lit(0))).withColumn("spaceType", F.coalesce("spaceType", F.lit(0)))
    have = live(spaces).select(F.col("userId").alias("_u"), F.col("spaceType").alias("_t")).distinct()
    met = asks.join(have, (F.col("asker") == F.col("_u")) & (F.col("spaceType") == F.col("_t")), "left")
    return met.withColumn("code", first_error(((F.col("spaceLevel") != 0) & ~F.col("asker_admin"), NO_AUTH), (F.col("_u").isNotNull(), OPERATION))).drop("_u", "_t")
