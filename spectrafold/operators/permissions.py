"""Permissions of users on spaces and pictures.

Lists of permissions are arrays in the order of their role; none is an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.sources.catalogue import PRIVATE, ROLE_PERMISSIONS, TEAM

from .predicates import live, outer_key
from .rules import NOT_FOUND, OK

VIEW, EDIT = "picture:view", "picture:edit"


def of_role(role: Column | str) -> Column:
    role = F.col(role) if isinstance(role, str) else role
    out = F.array().cast("array<string>")
    for name, permissions in ROLE_PERMISSIONS.items():
        out = F.when(role == name, F.array(*[F.lit(p) for p in permissions])).otherwise(out)
    return out


def _all() -> Column:
    return of_role(F.lit("admin"))


def _none() -> Column:
    return F.array().cast("array<string>")


def has(permissions: Column | str, wanted: list[str], every: bool = True) -> Column:
    """Gate: all of the wanted permissions, or any of them."""
    lists = F.array(*[F.lit(w) for w in wanted])
    return F.size(F.array_except(lists, permissions)) == 0 if every else F.arrays_overlap(lists, permissions)


def has_or_role(permissions: Column | str, wanted: list[str], own_roles: Column | str, roles: list[str], every: bool = True) -> Column:
    """Gate: the permissions, or else one of the roles; an entry of several roles with commas asks for all of them."""
    out = has(permissions, wanted, every)
    for entry in roles:
        out |= F.size(F.array_except(F.array(*[F.lit(r.strip()) for r in entry.split(",")]), own_roles)) == 0
    return out


def site_gate(role: str | None) -> Column:
    """Whether a user passes the gate of a role of the site: no role lets everyone in, `admin` administrators alone."""
    return F.lit(role is None) | (F.col("userRole") == role)


def _space_case(no_space: Column) -> Column:
    """By the columns _space_id, _type, _owner, _role, asker, asker_admin."""
    own = (F.col("_owner") == F.col("asker")) | F.col("asker_admin")
    private = F.when(own, _all()).otherwise(_none())
    return F.when(F.col("_space_id").isNull(), no_space).when(F.col("_type") == PRIVATE, private).when(F.col("_type") == TEAM, of_role("_role")).otherwise(_none())


def with_space_and_role(asks: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """asks (asker, asker_admin, spaceId) with the live space and the asker's role in it."""
    space = live(spaces).select(F.col("id").alias("_space_id"), F.col("spaceType").alias("_type"), F.col("userId").alias("_owner"))
    role = members.select(F.col("spaceId").alias("_member_space"), F.col("userId").alias("_member"), F.col("spaceRole").alias("_role"))
    met = asks.withColumn("_space", outer_key("spaceId", asks)).join(space, F.col("_space") == F.col("_space_id"), "left")
    return met.join(role, (F.col("_space") == F.col("_member_space")) & (F.col("asker") == F.col("_member")), "left").drop("_space", "_member_space", "_member")


def on_space(asks: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """asks with `permissions` on the space; without a space, administrators have all and others view."""
    no_space = F.when(F.col("asker_admin"), _all()).otherwise(F.array(F.lit(VIEW)))
    return with_space_and_role(asks, spaces, members).withColumn("permissions", _space_case(no_space)).drop("_space_id", "_type", "_owner", "_role")


def on_picture(asks: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """asks (asker, asker_admin, spaceId, picture_owner) with `permissions` on the picture: the owner of a public picture has all. A missing space gives null."""
    public = F.when((F.col("picture_owner") == F.col("asker")) | F.col("asker_admin"), _all()).otherwise(F.array(F.lit(VIEW)))
    missing = F.when(F.col("spaceId").isNull(), public)
    return with_space_and_role(asks, spaces, members).withColumn("permissions", _space_case(missing)).drop("_space_id", "_type", "_owner", "_role")


def may_write(pictures: DataFrame) -> Column:
    """Public pictures: owner or administrator; pictures of a space: owner only."""
    own = F.col("userId") == F.col("asker")
    return F.when(F.col("spaceId").isNull(), own | F.col("asker_admin")).otherwise(own)


def admitted(asks: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """asks with `admitted` to the edit stream: the space is of the team type, or there is none, and the asker may edit."""
    met = with_space_and_role(asks, spaces, members)
    no_space = F.when(F.col("asker_admin"), _all()).otherwise(F.array(F.lit(VIEW)))
    fits = F.col("spaceId").isNull() | F.coalesce(F.col("_type") == TEAM, F.lit(False))
    return met.withColumn("admitted", fits & has(_space_case(no_space), [EDIT])).drop("_space_id", "_type", "_owner", "_role")


def handshakes(asks: DataFrame, users: DataFrame, pictures: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """asks (userId, pictureId and others) to join the room of a picture, with `refused`: the first of the reasons below, or null if let in.

    picture_id: none given; login: no such live user; picture: no such live picture; space: its space is gone; team: its
    space isn't of the team type; permission: the user may not edit. Asks have no column spaceId, asker or asker_admin.
    """
    user = live(users).select(F.col("id").alias("_user"), (F.col("userRole") == "admin").alias("asker_admin"))
    picture = live(pictures).select(F.col("id").alias("_picture"), "spaceId")
    own = asks.withColumn("asker", F.col("userId")).withColumn("_u", outer_key("userId", asks)).withColumn("_p", outer_key("pictureId", asks))
    met = own.join(user, F.col("_u") == F.col("_user"), "left").join(picture, F.col("_p") == F.col("_picture"), "left")
    met = with_space_and_role(met.withColumn("asker_admin", F.coalesce("asker_admin", F.lit(False))), spaces, members)
    no_space = F.when(F.col("asker_admin"), _all()).otherwise(F.array(F.lit(VIEW)))
    in_space = F.col("spaceId").isNotNull()
    reasons = (
        ("picture_id", F.col("pictureId").isNull()),
        ("login", F.col("_user").isNull()),
        ("picture", F.col("_picture").isNull()),
        ("space", in_space & F.col("_space_id").isNull()),
        ("team", in_space & ~F.coalesce(F.col("_type") == TEAM, F.lit(False))),
        ("permission", ~has(_space_case(no_space), [EDIT])),
    )
    refused = F.coalesce(*[F.when(wrong, F.lit(name)) for name, wrong in reasons])
    return met.withColumn("refused", refused).select(*asks.columns, "refused")


def on_context(asks: DataFrame, pictures: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """asks (asker, asker_admin, memberRole, spaceUserId, spaceId, pictureId, each null if absent) with `permissions` and `code`, an error or 0.

    The first of these that is given decides: a membership with its role; the id of a membership, by the asker's role in
    the same space; the space; the picture, by its space or, for a public one, its owner. With none, all is allowed.
    """
    target = members.select(F.col("id").alias("_membership"), F.col("spaceId").alias("_member_space_id"))
    picture = live(pictures).select(F.col("id").alias("_picture"), F.col("spaceId").alias("_picture_space"), F.col("userId").alias("picture_owner"))
    own = asks.withColumn("_m", outer_key("spaceUserId", asks)).withColumn("_p", outer_key("pictureId", asks)).withColumnRenamed("spaceId", "_asked_space")
    met = own.join(target, F.col("_m") == F.col("_membership"), "left").join(picture, F.col("_p") == F.col("_picture"), "left")
    by_member, by_space, by_picture = F.col("spaceUserId").isNotNull(), F.col("_asked_space").isNotNull(), F.col("pictureId").isNotNull()
    met = met.withColumn("spaceId", F.when(by_member, F.col("_member_space_id")).when(by_space, F.col("_asked_space")).otherwise(F.col("_picture_space")))
    met = with_space_and_role(met, spaces, members)
    role = F.coalesce(of_role("_role"), _none())
    public = F.when((F.col("picture_owner") == F.col("asker")) | F.col("asker_admin"), _all()).otherwise(F.array(F.lit(VIEW)))
    missing = F.when(by_member, F.col("_membership").isNull()).when(by_space, F.col("_space_id").isNull())
    missing = missing.when(by_picture, F.col("_picture").isNull() | (F.col("_picture_space").isNotNull() & F.col("_space_id").isNull()))
    missing = F.col("memberRole").isNull() & F.coalesce(missing, F.lit(False))
    allowed = F.when(F.col("memberRole").isNotNull(), of_role("memberRole")).when(by_member, role).when(by_space | F.col("_picture_space").isNotNull(), _space_case(_none())).when(by_picture, public).otherwise(_all())
    out = met.withColumn("code", F.when(missing, F.lit(NOT_FOUND)).otherwise(F.lit(OK))).withColumn("permissions", F.when(~missing, allowed))
    return out.select(*[c for c in asks.columns if c != "spaceId"], F.col("_asked_space").alias("spaceId"), "permissions", "code")
