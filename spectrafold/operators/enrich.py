"""Views and the joins that put nested owners, spaces and roles beside rows.

The build sides (users, spaces) grow with the data, so no side is forced to be
broadcast: Spark does that where their measured size allows. Pages are cut
before they are enriched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import live

USER_VIEW = ("id", "userAccount", "userName", "userAvatar", "userProfile", "userRole", "createTime")
LOGIN_VIEW = (*USER_VIEW, "updateTime")
PICTURE_VIEW = (
    *("id", "url", "thumbnailUrl", "name", "introduction", "category", "picSize", "picWidth", "picHeight", "picScale", "picFormat"),
    *("userId", "spaceId", "createTime", "editTime", "updateTime"),
)
SPACE_VIEW = ("id", "userId", "spaceName", "spaceLevel", "spaceType", "maxSize", "maxCount", "createTime", "editTime", "updateTime")
MEMBER_VIEW = ("id", "spaceId", "userId", "spaceRole")


def user_view(users: DataFrame) -> DataFrame:
    return users.select(*USER_VIEW)


def login_view(users: DataFrame) -> DataFrame:
    return users.select(*LOGIN_VIEW)


def picture_view(pictures: DataFrame) -> DataFrame:
    """Without review fields; tags as a list."""
    return pictures.select(*PICTURE_VIEW, F.from_json("tags", "array<string>").alias("tagList"))


def picture_row(view: DataFrame) -> DataFrame:
    """Back from the view: tags as JSON text."""
    return view.withColumn("tags", F.to_json("tagList")).drop("tagList")


def space_view(spaces: DataFrame) -> DataFrame:
    return spaces.select(*SPACE_VIEW)


def space_row(view: DataFrame) -> DataFrame:
    """Back from the view, without what is nested in it."""
    return view.select(*SPACE_VIEW)


def member_view(members: DataFrame) -> DataFrame:
    return members.select(*MEMBER_VIEW)


def member_row(view: DataFrame) -> DataFrame:
    """Back from the view, without the nested user and space."""
    return view.select(*MEMBER_VIEW)


def team_menu(members: DataFrame) -> DataFrame:
    return members.select(F.concat(F.lit("/space/"), "spaceId").alias("key"), F.col("spaceName").alias("label"))


def with_user(rows: DataFrame, users: DataFrame, key: Column | str = "userId", name: str = "user") -> DataFrame:
    """rows with a nested user view, null where the user is absent or deleted."""
    nested = user_view(live(users)).select(F.col("id").alias("_key"), F.struct(*USER_VIEW).alias(name))
    on = F.col(key) if isinstance(key, str) else key
    return rows.withColumn("_on", on).join(nested, F.col("_on") == F.col("_key"), "left").drop("_on", "_key")


def with_space(rows: DataFrame, spaces: DataFrame, name: str = "space") -> DataFrame:
    nested = space_view(live(spaces)).select(F.col("id").alias("_key"), F.struct(*SPACE_VIEW).alias(name))
    return rows.join(nested, F.col("spaceId") == F.col("_key"), "left").drop("_key")


def positive(key: str) -> Column:
    """The key where it is over 0: single lookups skip other keys."""
    return F.when(F.col(key) > 0, F.col(key))


def members(rows: DataFrame, users: DataFrame, spaces: DataFrame) -> DataFrame:
    return with_space(with_user(rows, users), spaces)


def members_with_owner(rows: DataFrame, users: DataFrame, spaces: DataFrame) -> DataFrame:
    return with_user(members(rows, users, spaces), users, F.when(F.col("space.userId") > 0, F.col("space.userId")), "owner")


def level_defaults(spaces: DataFrame, levels: DataFrame) -> DataFrame:
    """spaces with quotas of their level where they have none of their own."""
    own = levels.select(F.col("value").alias("_level"), F.col("maxCount").alias("_count"), F.col("maxSize").alias("_size"))
    met = spaces.join(F.broadcast(own), F.col("spaceLevel") == F.col("_level"), "left")  # three fixed rows
    return met.withColumn("maxCount", F.coalesce("maxCount", "_count")).withColumn("maxSize", F.coalesce("maxSize", "_size")).drop("_level", "_count", "_size")
