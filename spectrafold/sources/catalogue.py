"""The catalogue's logical tables, derived from the Parquet tables of a folder, and its literal lookups.

Each derivation is one SQL text that Spark and the checking engine both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
LEVELS = ((0, "普通版", 100, 104857600), (1, "专业版", 1000, 1048576000), (2, "旗舰版", 10000, 10485760000))
SPACE_TYPES = ((0, "私有空间"), (1, "团队空间"))
REVIEW_STATES = ((0, "待审核"), (1, "通过"), (2, "拒绝"))
ROLES = (("viewer", "浏览者"), ("editor", "编辑者"), ("admin", "管理员"))
ROLE_PERMISSIONS = {
    "viewer": ("picture:view",),
    "editor": ("picture:view", "picture:upload", "picture:edit", "picture:delete"),
    "admin": ("spaceUser:manage", "picture:view", "picture:upload", "picture:edit", "picture:delete"),
}
TAGS = ("热门", "搞笑", "生活", "高清", "艺术", "校园", "背景", "简历", "创意")
CATEGORIES = ("模板", "电商", "表情包", "素材", "海报")
PRIVATE, TEAM = 0, 1
PENDING, PASS, REJECT = 0, 1, 2
SALT = "salt"

#: Table: its Parquet source and derivation.
DERIVED: dict[str, tuple[str, str]] = {
    "g_user": (
        "customer",
        """select c_custkey + 1 as id, c_name as userAccount, c_name as userName, md5(concat('salt', c_name)) as userPassword, c_mktsegment as userProfile, concat('http://avatar/', c_custkey, '.png') as userAvatar,
        cast(cast('2024-01-01' as date) + cast(c_custkey % 365 as int) as string) as createTime, cast(cast('2025-01-01' as date) + cast(c_custkey % 365 as int) as string) as updateTime,
        case when c_custkey % 50 = 0 then 'admin' else 'user' end as userRole, case when c_custkey % 17 = 3 then 1 else 0 end as isDelete from customer""",
    ),
    "g_space": (
        "supplier",
        """select s_suppkey + 1 as id, s_suppkey + 1 as userId, s_name as spaceName, cast(s_suppkey % 3 as int) as spaceLevel, cast(s_suppkey % 2 as int) as spaceType,
        cast(null as bigint) as maxSize, cast(null as bigint) as maxCount,
        cast(cast('2024-01-01' as date) + cast(s_suppkey % 365 as int) as string) as createTime, cast(cast('2025-01-01' as date) + cast(s_suppkey % 365 as int) as string) as editTime,
        cast(cast('2025-02-01' as date) + cast(s_suppkey % 365 as int) as string) as updateTime, case when s_suppkey % 11 = 10 then 1 else 0 end as isDelete from supplier""",
    ),
    "g_picture": (
        "orders",
        """select o_orderkey + 1 as id, concat('http://img/', o_orderkey, '.png?x=1') as url, concat(o_orderpriority, ' pic ', o_orderkey) as name,
        case when o_orderkey % 7 = 0 then null else concat('intro ', o_orderstatus) end as introduction, o_orderpriority as category,
        case when o_orderkey % 13 = 0 then null else concat('["', o_orderstatus, '","t', o_orderkey % 5, '"]') end as tags,
        cast(floor(o_totalprice) as bigint) as picSize, cast(o_orderkey % 1920 + 1 as int) as picWidth, cast(o_orderkey % 1080 + 1 as int) as picHeight,
        case o_orderkey % 3 when 0 then 'png' when 1 then 'jpg' else 'webp' end as picFormat, o_custkey + 1 as userId,
        case when o_orderkey % 3 = 0 then null else o_orderkey % 12 + 1 end as spaceId,
        case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end as reviewStatus, o_orderdate as createTime,
        o_orderdate + interval 1 day as editTime, o_orderdate + interval 2 day as updateTime, concat('http://img/', o_orderkey, '_thumbnail.png') as thumbnailUrl,
        cast(o_orderkey % 1920 + 1 as double) / cast(o_orderkey % 1080 + 1 as double) as picScale,
        case when o_orderkey % 29 = 7 then 1 else 0 end as isDelete from orders""",
    ),
    "g_space_user": (
        "orders",
        """select min(o_orderkey) + 1 as id, o_orderkey % 12 + 1 as spaceId, o_custkey + 1 as userId,
        case min(o_orderkey) % 3 when 0 then 'viewer' when 1 then 'editor' else 'admin' end as spaceRole from orders group by o_orderkey % 12 + 1, o_custkey + 1""",
    ),
    # Connections: who joins at an event acts in it, who leaves still does so; messages of the event stand at 4 * seq + 1.
    "g_session": (
        "events",
        """select event_id * 4 + case event_type when 'signup' then 0 else 2 end as moment, user_id + 1 as userId, cast({k} as bigint) + 1 as pictureId,
        case event_type when 'signup' then 'JOIN' else 'LEAVE' end as type from events where event_type in ('signup', 'purchase')""",
    ),
    # Rooms: two sessions a user; who signs up joins, then asks for the lock; a purchase ends editing, every other one by closing the session.
    "g_room": (
        "events",
        """select cast(ts as timestamp) as at, event_id * 4 + step as moment, cast({k} as bigint) + 1 as pictureId, user_id + 1 as userId, (user_id + 1) * 2 + cast(floor(event_id / 8) as bigint) % 2 as sessionId,
        case when event_type = 'signup' then case step when 0 then 'JOIN' else 'ENTER_EDIT' end when event_type = 'purchase' then case when event_id % 4 < 2 then 'DISCONNECT' else 'EXIT_EDIT' end
        when event_type = 'error' then 'BOGUS' else 'EDIT_ACTION' end as type,
        case when event_type in ('click', 'view') then case event_id % 5 when 0 then 'ZOOM_IN' when 1 then 'ZOOM_OUT' when 2 then 'ROTATE_LEFT' when 3 then 'ROTATE_RIGHT' else 'NOPE' end end as editAction
        from (select *, 1 as step from events union all select *, 0 as step from events where event_type = 'signup') x""",
    ),
    "g_ev": (
        "events",
        """select event_id as seq, ts, user_id + 1 as userId, cast({k} as bigint) + 1 as pictureId,
        case event_type when 'signup' then 'ENTER_EDIT' when 'purchase' then 'EXIT_EDIT' when 'error' then 'BOGUS' else 'EDIT_ACTION' end as type,
        case when event_type in ('click', 'view') then case event_id % 5 when 0 then 'ZOOM_IN' when 1 then 'ZOOM_OUT' when 2 then 'ROTATE_LEFT' when 3 then 'ROTATE_RIGHT' else 'NOPE' end end as editAction
        from events""",
    ),
}
_JSON = {"spark": "get_json_object(props, '$.k')", "check": "json_extract_string(props, '$.k')"}


def derive(spark: SparkSession, name: str, source: DataFrame) -> DataFrame:
    """A logical table from its source, which may be a stream."""
    origin, text = DERIVED[name]
    return spark.sql(text.replace("{k}", _JSON["spark"]).replace(f"from {origin}", "from {source}"), source=source)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table (g_...) or a Parquet table of the folder."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return derive(spark, name, table(spark, sf_dir, DERIVED[name][0]))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a stream over the files of its source."""
    # Braces make the path a pattern: a file source takes a pattern or a folder, not one file.
    origin = DERIVED[name][0]
    schema = spark.read.parquet(f"{sf_dir}/{origin}.parquet").schema
    return derive(spark, name, spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{origin}}}.parquet"))


def with_tables(*names: str) -> str:
    """The `with` clause that gives the logical tables to a checking query."""
    return "with " + ", ".join(f"{n} as ({DERIVED[n][1].replace('{k}', _JSON['check'])})" for n in names)


def literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A lookup of a few fixed rows."""
    return spark.createDataFrame(list(rows), schema)


def levels(spark: SparkSession) -> DataFrame:
    return literal(spark, LEVELS, "value int, text string, maxCount bigint, maxSize bigint")


def role_permissions(spark: SparkSession) -> DataFrame:
    """role, place, permission."""
    return literal(spark, [(r, i, p) for r, ps in ROLE_PERMISSIONS.items() for i, p in enumerate(ps)], "role string, place int, permission string")


def tag_categories(spark: SparkSession) -> DataFrame:
    return literal(spark, [("tag", i, t) for i, t in enumerate(TAGS)] + [("category", i, c) for i, c in enumerate(CATEGORIES)], "kind string, place int, label string")
