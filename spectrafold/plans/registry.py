"""Registered catalogue queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.functions import scalars as fn
from spectrafold.operators import admission, enrich, ids, ingest, mutate, paging, permissions, rules, touched
from spectrafold.operators.paging import Page
from spectrafold.operators.predicates import Query, live, masked, menu_visible, public_visible, space_visible
from spectrafold.plans.cache import cached
from spectrafold.sources import catalogue as cat
from spectrafold.sources.folders import shared_folder
from spectrafold.streaming import batches, collab
from spectrafold.streaming import rooms as room

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The logical tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        names = {"users": "g_user", "spaces": "g_space", "pictures": "g_picture", "members": "g_space_user", "messages": "g_ev", "log": "g_session", "rooms": "g_room"}
        return cat.table(self.spark, self.sf_dir, names.get(name, name))


def query(tables: str, sql: str):
    """Register a function of Tables under its name; sql continues the `with` clause of these logical tables."""

    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _SQL[f.__name__] = (cat.with_tables(*tables.split()) + " " if tables else "") + sql
        return f

    return register


_LIVE_PUBLIC = "isDelete = 0 and reviewStatus = 1 and spaceId is null"


@query(
    "g_picture g_user",
    f"""select p.id, p.name, p.category, p.picSize, p.createTime, u.id as ownerId, u.userName as ownerName from (select * from g_picture where {_LIVE_PUBLIC}
    order by createTime desc nulls last, id limit 12) p left join (select * from g_user where isDelete = 0) u on p.userId = u.id""",
)
def page_public_newest(t: Tables) -> DataFrame:
    page = paging.records(live(t.pictures).where(public_visible()), paging.guard(Page(1, 12, "createTime")))
    return enrich.with_user(page, t.users).select("id", "name", "category", "picSize", "createTime", F.col("user.id").alias("ownerId"), F.col("user.userName").alias("ownerName"))


@query("g_picture", f"select count(*) as total from g_picture where {_LIVE_PUBLIC}")
def page_total_public(t: Tables) -> DataFrame:
    return paging.total(live(t.pictures).where(public_visible()))


@query("g_picture", "select id, name, spaceId from g_picture where isDelete = 0 and reviewStatus = 1 and spaceId = 5 order by id limit 10 offset 10")
def page_space_scope(t: Tables) -> DataFrame:
    return paging.records(live(t.pictures).where(space_visible(5)), Page(2, 10)).select("id", "name", "spaceId")


@query("g_picture", "select id, name, spaceId from g_picture where isDelete = 0 and reviewStatus = 1 order by name asc nulls first, id limit 20")
def list_cached_scope(t: Tables) -> DataFrame:
    return paging.records(live(t.pictures).where(F.col("reviewStatus") == cat.PASS), Page(1, 20, "name", "ascend")).select("id", "name", "spaceId")


@query("g_picture", "select id, name from g_picture where isDelete = 0 order by createTime desc nulls last, id limit 50")
def page_admin_unbounded(t: Tables) -> DataFrame:
    return paging.records(live(t.pictures), Page(1, 50, "createTime")).select("id", "name")


@query("g_picture", "select id, userId, category from g_picture where isDelete = 0 and spaceId = 2 and lower(category) = lower('1-urgent') and reviewStatus = 0 and picFormat = 'jpg'")
def filter_eq_all(t: Tables) -> DataFrame:
    q = Query(equals={"spaceId": 2, "category": "1-URGENT", "reviewStatus": 0, "picFormat": "JPG", "userId": None, "picWidth": None})
    return live(t.pictures).where(q.predicate()).select("id", "userId", "category")


@query("g_picture", "select id, name from g_picture where isDelete = 0 and name ilike '%high_pic 1%'")
def filter_like_name(t: Tables) -> DataFrame:
    return live(t.pictures).where(Query(contains={"name": "high_pic 1", "introduction": " "}).predicate()).select("id", "name")


@query("g_picture", "select id, picFormat from g_picture where isDelete = 0 and picFormat ilike '%P%'")
def filter_like_format(t: Tables) -> DataFrame:
    return live(t.pictures).where(Query(contains={"picFormat": "P"}).predicate()).select("id", "picFormat")


@query("g_picture", "select id, name, introduction from g_picture where isDelete = 0 and (name ilike '%intro o%' or introduction ilike '%intro o%')")
def search_text_or(t: Tables) -> DataFrame:
    return live(t.pictures).where(Query(search="INTRO O").predicate()).select("id", "name", "introduction")


@query("g_picture", f"select id from g_picture where {_LIVE_PUBLIC} and lower(category) = '2-high'")
def filter_public_category(t: Tables) -> DataFrame:
    q = Query(public_only=True, category="2-HIGH", equals={"reviewStatus": 1})
    return live(t.pictures).where(q.predicate()).where(Query(category="all").predicate()).select("id")


@query("g_picture", """select id, tags from g_picture where isDelete = 0 and tags ilike '%"F"%' and tags ilike '%"t3"%'""")
def filter_tags_all_text(t: Tables) -> DataFrame:
    return live(t.pictures).where(Query(tags=["F", "t3"]).predicate()).select("id", "tags")


@query("g_picture", """select id, tags from g_picture where isDelete = 0 and list_contains(cast(tags::json as varchar[]), 'F') and list_contains(cast(tags::json as varchar[]), 't3')""")
def filter_tags_all_typed(t: Tables) -> DataFrame:
    return live(t.pictures).where(Query(tags=["F", "t3"], typed_tags=True).predicate()).select("id", "tags")


@query("g_space", "select id, spaceName from g_space where isDelete = 0 and spaceLevel = 1 and spaceType = 0 and spaceName ilike '%supplier%'")
def filter_space(t: Tables) -> DataFrame:
    return live(t.spaces).where(Query(equals={"spaceLevel": 1, "spaceType": 0}, contains={"spaceName": "supplier"}).predicate()).select("id", "spaceName")


@query("g_user", "select id, userAccount from g_user where isDelete = 0 and userRole = 'user' and userProfile ilike '%build%' and userAccount ilike '%1%'")
def filter_user(t: Tables) -> DataFrame:
    return live(t.users).where(Query(equals={"userRole": "USER"}, contains={"userProfile": "build", "userAccount": "1"}).predicate()).select("id", "userAccount")


@query("g_space_user", "select id, spaceId, userId from g_space_user where spaceId = 3 and spaceRole = 'admin'")
def filter_member(t: Tables) -> DataFrame:
    return t.members.where(Query(equals={"spaceId": 3, "spaceRole": "admin"}).predicate()).select("id", "spaceId", "userId")


@query("g_user", "select id, userName from g_user where isDelete = 0 and lower(userAccount) = (select lower(userAccount) from g_user where id = 7) and userPassword = (select userPassword from g_user where id = 7)")
def filter_credentials(t: Tables) -> DataFrame:
    given = t.users.where(F.col("id") == 7).select(F.lower("userAccount").alias("_account"), F.col("userPassword").alias("_password"))
    on = (F.lower("userAccount") == F.col("_account")) & (F.col("userPassword") == F.col("_password"))
    return live(t.users).join(given, on, "left_semi").select("id", "userName")


@query("g_picture", "select id, name, userId from g_picture where isDelete = 0 and id = 42")
def lookup_by_id(t: Tables) -> DataFrame:
    return live(t.pictures).where(F.col("id") == 42).select("id", "name", "userId")


@query("g_picture g_user", "select id, userName from g_user where isDelete = 0 and id in (select userId from g_picture where isDelete = 0 and spaceId = 2)")
def lookup_by_ids(t: Tables) -> DataFrame:
    keys = live(t.pictures).where(F.col("spaceId") == 2).select("userId").distinct()
    return live(t.users).join(keys, F.col("id") == F.col("userId"), "left_semi").select("id", "userName")


@query("g_space_user", "select id, spaceRole from g_space_user where spaceId = 2 and userId = (select min(userId) from g_space_user where spaceId = 2)")
def lookup_unique_member(t: Tables) -> DataFrame:
    first = t.members.where(F.col("spaceId") == 2).agg(F.min("userId").alias("_u"))
    return paging.one(t.members.where(F.col("spaceId") == 2).join(first, F.col("userId") == F.col("_u"), "left_semi").select("id", "spaceRole"))


@query("g_space_user", "select id, userId, spaceRole from g_space_user where spaceId = 4")
def list_members_unpaged(t: Tables) -> DataFrame:
    return t.members.where(F.col("spaceId") == 4).select("id", "userId", "spaceRole")


@query("g_picture", "select * from (select id, url, name, picSize from g_picture where userId = 11) x")
def diagnostic_sql(t: Tables) -> DataFrame:
    return t.spark.sql("select id, url, name, picSize from {p} where userId = 11", p=t.pictures)


@query(
    "g_picture g_user",
    "select p.id, p.userId, u.userName, u.userRole from g_picture p left join (select * from g_user where isDelete = 0) u on p.userId = u.id where p.isDelete = 0",
)
def enrich_picture_user(t: Tables) -> DataFrame:
    return enrich.with_user(live(t.pictures), t.users).select("id", "userId", F.col("user.userName").alias("userName"), F.col("user.userRole").alias("userRole"))


@query("g_space g_user", "select s.id, s.spaceName, u.userName from g_space s left join (select * from g_user where isDelete = 0) u on s.userId = u.id where s.isDelete = 0")
def enrich_space_user(t: Tables) -> DataFrame:
    return enrich.with_user(live(t.spaces), t.users).select("id", "spaceName", F.col("user.userName").alias("userName"))


@query(
    "g_space g_user g_space_user",
    """select m.id, m.spaceRole, u.userName, s.spaceName from g_space_user m left join (select * from g_user where isDelete = 0) u on m.userId = u.id
    left join (select * from g_space where isDelete = 0) s on m.spaceId = s.id""",
)
def enrich_member(t: Tables) -> DataFrame:
    return enrich.members(t.members, t.users, t.spaces).select("id", "spaceRole", F.col("user.userName").alias("userName"), F.col("space.spaceName").alias("spaceName"))


@query(
    "g_space g_user g_space_user",
    """select m.id, u.userName, s.spaceName, o.userName as ownerName from g_space_user m left join (select * from g_user where isDelete = 0) u on m.userId = u.id
    left join (select * from g_space where isDelete = 0) s on m.spaceId = s.id left join (select * from g_user where isDelete = 0) o on s.userId = o.id and s.userId > 0""",
)
def enrich_member_owner_chain(t: Tables) -> DataFrame:
    rows = enrich.members_with_owner(t.members, t.users, t.spaces)
    return rows.select("id", F.col("user.userName").alias("userName"), F.col("space.spaceName").alias("spaceName"), F.col("owner.userName").alias("ownerName"))


@query("g_picture g_user", "select p.id, u.userName from g_picture p left join (select * from g_user where isDelete = 0) u on p.userId = u.id and p.userId > 0 where p.isDelete = 0 and p.id = 100")
def enrich_single_picture(t: Tables) -> DataFrame:
    one = live(t.pictures).where(F.col("id") == 100)
    return enrich.with_user(one, t.users, enrich.positive("userId")).select("id", F.col("user.userName").alias("userName"))


@query(
    "g_space g_space_user",
    """select concat('/space/', m.spaceId) as key, s.spaceName as label from g_space_user m left join (select * from g_space where isDelete = 0) s on m.spaceId = s.id
    where m.userId = 10""",
)
def my_team_spaces(t: Tables) -> DataFrame:
    mine = enrich.with_space(t.members.where(F.col("userId") == 10), t.spaces)
    return enrich.team_menu(mine.select("spaceId", F.col("space.spaceName").alias("spaceName")))


@query("g_space g_user", "select u.id, k.spaceType, exists (select 1 from g_space s where s.isDelete = 0 and s.userId = u.id and s.spaceType = k.spaceType) as found from g_user u cross join (values (0), (1)) k(spaceType) where u.isDelete = 0")
def exists_space_per_type(t: Tables) -> DataFrame:
    kinds = live(t.users).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("spaceType"))
    have = live(t.spaces).select(F.col("userId").alias("_u"), F.col("spaceType").alias("_t")).distinct()
    met = kinds.join(have, (F.col("id") == F.col("_u")) & (F.col("spaceType") == F.col("_t")), "left")
    return met.select("id", "spaceType", F.col("_u").isNotNull().alias("found"))


_LEVELS = "(values (0, 100, 104857600), (1, 1000, 1048576000), (2, 10000, 10485760000)) l(v, c, s)"


@query("g_space", f"select id, spaceLevel, coalesce(maxCount, l.c)::bigint as maxCount, coalesce(maxSize, l.s)::bigint as maxSize from g_space left join {_LEVELS} on spaceLevel = l.v where isDelete = 0")
def level_defaults(t: Tables) -> DataFrame:
    return enrich.level_defaults(live(t.spaces), cat.levels(t.spark)).select("id", "spaceLevel", "maxCount", "maxSize")


@query("", "select * from (values (0, '普通版', 100::bigint, 104857600::bigint), (1, '专业版', 1000, 1048576000), (2, '旗舰版', 10000, 10485760000)) x(value, text, maxCount, maxSize)")
def list_levels(t: Tables) -> DataFrame:
    return cat.levels(t.spark)


@query("", "select 'tag' as kind, i::int as place, x as label from (select unnest(['热门','搞笑','生活','高清','艺术','校园','背景','简历','创意']) as x, unnest(range(9)) as i) union all select 'category', i::int, x from (select unnest(['模板','电商','表情包','素材','海报']) as x, unnest(range(5)) as i)")
def list_tag_categories(t: Tables) -> DataFrame:
    return cat.tag_categories(t.spark)


@query("g_user", "select count(*) as total from g_user where isDelete = 0 and userRole = 'admin'")
def count_admins(t: Tables) -> DataFrame:
    return paging.total(live(t.users).where(F.col("userRole") == "admin"))


@query("g_user", "select count(*) as total from g_user where isDelete = 0 and lower(userAccount) = lower('customer#000000010')")
def count_dup_account(t: Tables) -> DataFrame:
    return paging.total(live(t.users).where(Query(equals={"userAccount": "customer#000000010"}).predicate()))


@query("g_picture", "select distinct userId from g_picture where isDelete = 0")
def distinct_owners(t: Tables) -> DataFrame:
    return live(t.pictures).select("userId").distinct()


@query("g_picture", "select spaceId, sum(picSize)::bigint as totalSize, count(*) as totalCount from g_picture where isDelete = 0 and spaceId is not null group by spaceId")
def space_usage(t: Tables) -> DataFrame:
    return rules.usage(t.pictures)


_USED = f"""used as (select s.id, coalesce(u.totalSize, 0)::bigint as totalSize, coalesce(u.totalCount, 0)::bigint as totalCount, l.c::bigint as maxCount, l.s::bigint as maxSize
    from g_space s left join (select spaceId, sum(picSize) as totalSize, count(*) as totalCount from g_picture where isDelete = 0 and spaceId is not null group by spaceId) u on s.id = u.spaceId
    left join {_LEVELS} on s.spaceLevel = l.v where s.isDelete = 0)"""


def _used(t: Tables) -> DataFrame:
    return rules.with_usage(enrich.level_defaults(live(t.spaces), cat.levels(t.spark)), rules.usage(t.pictures))


@query("g_space g_picture", f", {_USED} select id, totalSize, totalCount, round(totalSize * 100.0::double / maxSize, 1) as sizePercent, round(totalCount * 100.0::double / maxCount, 1) as countPercent from used")
def space_usage_percent(t: Tables) -> DataFrame:
    return _used(t).select("id", "totalSize", "totalCount", fn.percent(F.col("totalSize"), F.col("maxSize")).alias("sizePercent"), fn.percent(F.col("totalCount"), F.col("maxCount")).alias("countPercent"))


@query("g_space g_picture", f", {_USED} select id, case when totalCount >= maxCount then 50001 when totalSize >= maxSize then 50001 else 0 end as code from used")
def quota_reject(t: Tables) -> DataFrame:
    return _used(t).select("id", rules.quota_error().alias("code"))


_ROLE_LIST = """case {r} when 'viewer' then 'picture:view' when 'editor' then 'picture:view,picture:upload,picture:edit,picture:delete'
    when 'admin' then 'spaceUser:manage,picture:view,picture:upload,picture:edit,picture:delete' else '' end"""
_ADMIN_LIST = "'spaceUser:manage,picture:view,picture:upload,picture:edit,picture:delete'"
#: Who asks about which space: members, and every owner about their own.
_ASKS = """asks as (select distinct a.spaceId, a.userId as asker, u.userRole = 'admin' as asker_admin from (select spaceId, userId from g_space_user union all select id, userId from g_space
    union all select null, id from g_user) a join (select * from g_user where isDelete = 0) u on a.userId = u.id)"""


def _asks(t: Tables) -> DataFrame:
    users = live(t.users).select(F.col("id").alias("asker"), (F.col("userRole") == "admin").alias("asker_admin"))
    about = t.members.select("spaceId", F.col("userId").alias("asker")).unionAll(t.spaces.select("id", "userId")).unionAll(t.users.select(F.lit(None).cast("bigint"), "id"))
    return about.distinct().join(users, "asker")


_SPACE_CASE = f"""when s.id is null then '?' when s.spaceType = 0 then case when s.userId = a.asker or a.asker_admin then {_ADMIN_LIST} else '' end
    else {_ROLE_LIST.format(r="m.spaceRole")} end"""
_MET = "asks a left join (select * from g_space where isDelete = 0) s on a.spaceId = s.id left join g_space_user m on m.spaceId = a.spaceId and m.userId = a.asker"


@query("g_user g_space g_space_user", f", {_ASKS} select a.spaceId, a.asker, case when s.id is null then case when a.asker_admin then {_ADMIN_LIST} else 'picture:view' end {_SPACE_CASE} as permissions from {_MET}")
def perm_space_matrix(t: Tables) -> DataFrame:
    return permissions.on_space(_asks(t), t.spaces, t.members).select("spaceId", "asker", F.array_join("permissions", ",").alias("permissions"))


_PICTURE_ASKS = """asks as (select p.id as pictureId, p.spaceId, p.userId as picture_owner, u.id as asker, u.userRole = 'admin' as asker_admin from g_picture p
    join (select * from g_user where isDelete = 0) u on u.id in (p.userId, p.id % 100 + 1) where p.isDelete = 0)"""


def _picture_asks(t: Tables) -> DataFrame:
    users = live(t.users).select(F.col("id").alias("asker"), (F.col("userRole") == "admin").alias("asker_admin"))
    rows = live(t.pictures).select(F.col("id").alias("pictureId"), "spaceId", F.col("userId").alias("picture_owner"), F.explode(F.array_distinct(F.array("userId", F.col("id") % 100 + 1))).alias("asker"))
    return rows.join(users, "asker")


@query(
    "g_user g_space g_space_user g_picture",
    f""", {_PICTURE_ASKS} select a.pictureId, a.asker, case when a.spaceId is null then case when a.picture_owner = a.asker or a.asker_admin then {_ADMIN_LIST} else 'picture:view' end
    when s.id is null then null {_SPACE_CASE} as permissions from {_MET}""",
)
def perm_context_matrix(t: Tables) -> DataFrame:
    return permissions.on_picture(_picture_asks(t), t.spaces, t.members).select("pictureId", "asker", F.array_join("permissions", ",").alias("permissions"))


@query(
    "",
    """select r as role, i::int as place, p as permission from (select 'viewer' as r, unnest(['picture:view']) as p, unnest(range(1)) as i
    union all select 'editor', unnest(['picture:view','picture:upload','picture:edit','picture:delete']), unnest(range(4))
    union all select 'admin', unnest(['spaceUser:manage','picture:view','picture:upload','picture:edit','picture:delete']), unnest(range(5)))""",
)
def perm_roles_exploded(t: Tables) -> DataFrame:
    return cat.role_permissions(t.spark)


@query("g_space_user", "select id, spaceRole in ('editor', 'admin') as canEdit, spaceRole = 'admin' as canManageAndView, true as canViewOrUpload from g_space_user")
def perm_gate(t: Tables) -> DataFrame:
    own = permissions.of_role("spaceRole")
    return t.members.select(
        "id",
        permissions.has(own, ["picture:edit"]).alias("canEdit"),
        permissions.has(own, ["spaceUser:manage", "picture:view"]).alias("canManageAndView"),
        permissions.has(own, ["picture:view", "picture:upload"], every=False).alias("canViewOrUpload"),
    )


@query("g_user g_picture", f", {_PICTURE_ASKS} select pictureId, asker, case when spaceId is null then picture_owner = asker or asker_admin else picture_owner = asker end as allowed from asks")
def picture_write_allowed(t: Tables) -> DataFrame:
    rows = _picture_asks(t).withColumn("userId", F.col("picture_owner"))
    return rows.select("pictureId", "asker", permissions.may_write(rows).alias("allowed"))


@query(
    "g_user g_space g_space_user",
    f""", {_ASKS} select a.spaceId, a.asker, (a.spaceId is null or coalesce(s.spaceType = 1, false)) and case when a.spaceId is null then a.asker_admin
    else coalesce(m.spaceRole in ('editor', 'admin'), false) end as admitted from {_MET}""",
)
def stream_admission(t: Tables) -> DataFrame:
    return permissions.admitted(_asks(t), t.spaces, t.members).select("spaceId", "asker", "admitted")


@query(
    "g_user g_picture",
    """select p.id, case when p.spaceId is null and u.userRole <> 'admin' then 0 else 1 end as newStatus, case when p.spaceId is null and u.userRole = 'admin' then '管理员自动过审'
    when p.spaceId is null then '公共空间，待审核' else concat('私有空间自动过审_spaceId=', p.spaceId) end as newMessage from g_picture p join g_user u on p.userId = u.id where p.isDelete = 0 and u.isDelete = 0""",
)
def review_defaults(t: Tables) -> DataFrame:
    users = live(t.users).select(F.col("id").alias("_u"), (F.col("userRole") == "admin").alias("asker_admin"))
    rows = live(t.pictures).join(users, F.col("userId") == F.col("_u"))
    return rows.select("id", *[c.alias(n) for n, c in rules.review_defaults().items()])


@query("g_picture", "select id, reviewStatus, (id % 4)::int as target, case when id % 4 not in (1, 2) then 40000 when reviewStatus = id % 4 then 40000 else 0 end as code from g_picture where isDelete = 0")
def review_transition(t: Tables) -> DataFrame:
    target = (F.col("id") % 4).cast("int")
    return live(t.pictures).select("id", "reviewStatus", target.alias("target"), rules.review_error(F.col("reviewStatus"), target).alias("code"))


@query(
    "",
    """select p_partkey as id, case when p_partkey % 9 = 0 then 40000 when p_partkey % 5 = 4 then 40000 when length(p_name) > 30 then 40000 when p_partkey % 3 = 2 then 40000 else 0 end as code from part""",
)
def validate_space(t: Tables) -> DataFrame:
    part = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("spaceName"),
        (F.col("p_partkey") % 5).cast("int").alias("spaceLevel"),
        (F.col("p_partkey") % 3).cast("int").alias("spaceType"),
    )
    part = part.withColumn("spaceLevel", F.when(F.col("spaceLevel") == 3, 1).otherwise(F.col("spaceLevel")))
    return part.select("id", rules.space_error(add=True).alias("code"))


@query(
    "g_user g_space g_space_user",
    """select m.id, case when u.id is null then 40400 when s.id is null then 40400 when m.id % 7 = 0 then 40000 else 0 end as code from g_space_user m
    left join (select * from g_user where isDelete = 0) u on m.userId = u.id left join (select * from g_space where isDelete = 0) s on m.spaceId = s.id""",
)
def validate_member(t: Tables) -> DataFrame:
    rows = t.members.withColumn("spaceRole", F.when(F.col("id") % 7 == 0, F.lit("owner")).otherwise(F.col("spaceRole")))
    return rules.member_errors(rows, t.users, t.spaces).select("id", "code")


@query("g_picture", "select id, case when id % 11 = 0 then 40000 else 0 end as code from g_picture")
def validate_picture(t: Tables) -> DataFrame:
    rows = t.pictures.withColumn("url", F.when(F.col("id") % 11 == 0, F.repeat(F.lit("x"), 1025)).otherwise(F.col("url")))
    return rows.select("id", rules.picture_error().alias("code"))


@query("g_picture", "select id, case when picSize * 10 > 2097152 then 40000 when id % 6 = 0 then 40000 else 0 end as code from g_picture")
def validate_upload(t: Tables) -> DataFrame:
    suffix = F.when(F.col("id") % 6 == 0, F.lit("PNG")).otherwise(F.col("picFormat"))
    return t.pictures.select("id", rules.upload_error(F.col("picSize") * 10, suffix).alias("code"))


@query(
    "g_picture",
    """select id, case when id % 5 = 0 then 40400 when id % 5 = 1 then 40000 when id % 5 = 2 then 40000 when id % 4 = 0 then 0 when id % 3 = 0 then 40000 when id % 7 = 0 then 40000
    when picSize * 10 > 2097152 then 40000 else 0 end as code from g_picture""",
)
def validate_url(t: Tables) -> DataFrame:
    i = F.col("id")
    url = F.when(i % 5 == 0, F.lit(" ")).when(i % 5 == 1, F.lit("no scheme")).when(i % 5 == 2, F.lit("ftp://x/y.png")).otherwise(F.col("url"))
    status = F.when(i % 4 == 0, F.lit(404)).otherwise(F.lit(200))
    kind = F.when(i % 3 == 0, F.lit("text/html")).otherwise(F.lit("IMAGE/PNG"))
    length = F.when(i % 7 == 0, F.lit("many")).otherwise((F.col("picSize") * 10).cast("string"))
    return t.pictures.select("id", rules.url_error(url, status, kind, length).alias("code"))


@query(
    "g_user",
    """select c_custkey as id, case when c_custkey % 8 = 0 then 40000 when c_custkey % 8 = 1 then 40000 when c_custkey % 8 = 2 then 40000 when c_custkey % 8 = 3 and exists
    (select 1 from g_user u where u.isDelete = 0 and lower(u.userAccount) = lower(c_name)) then 40000 else 0 end as code from customer""",
)
def validate_register(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 8
    rows = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(k == 0, F.lit("a")).when(k == 3, F.lower("c_name")).otherwise(F.concat(F.lit("new-"), "c_name")).alias("account"),
        F.when(k == 1, F.lit("p")).otherwise(F.lit("secret-word")).alias("password"),
        F.when(k == 2, F.lit("other-word")).when(k == 1, F.lit("p")).otherwise(F.lit("secret-word")).alias("again"),
    )
    return rules.register_errors(rows, t.users).select("id", "code")


@query(
    "g_user g_space",
    """select u.id, case when u.id % 3 <> 0 and u.userRole <> 'admin' then 40101 when exists (select 1 from g_space s where s.isDelete = 0 and s.userId = u.id and s.spaceType = u.id % 2) then 50001 else 0 end as code
    from g_user u where u.isDelete = 0""",
)
def validate_new_space(t: Tables) -> DataFrame:
    asks = live(t.users).select(
        F.col("id").alias("asker"),
        (F.col("userRole") == "admin").alias("asker_admin"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 3).cast("int")).alias("spaceLevel"),
        F.when(F.col("id") % 2 == 1, F.lit(1)).alias("spaceType"),
    )
    return rules.new_space_errors(asks, t.spaces).select(F.col("asker").alias("id"), "code")


@query("g_space", "select id, spaceName from g_space union all select id + 1000000, concat('new ', spaceName) from g_space where spaceType = 1")
def insert_space(t: Tables) -> DataFrame:
    base = t.spaces.select("id", "spaceName")
    return mutate.insert(base, t.spaces.where("spaceType = 1").select((F.col("id") + 1000000).alias("id"), F.concat(F.lit("new "), "spaceName").alias("spaceName")))


@query("g_picture", "select id, name from g_picture where id % 10 <> 0 union all select id, concat('v2 ', name) from g_picture where id % 10 = 0 union all select id + 10000000, 'added' from g_picture where id % 100 = 0")
def upsert_picture(t: Tables) -> DataFrame:
    base = t.pictures.select("id", "name")
    again = base.where("id % 10 = 0").select("id", F.concat(F.lit("v2 "), "name").alias("name"))
    added = base.where("id % 100 = 0").select((F.col("id") + 10000000).alias("id"), F.lit("added").alias("name"))
    return mutate.upsert(base, again.unionAll(added))


@query("g_picture", "select id, case when id % 4 = 0 then concat('patched ', id) else name end as name, introduction, case when id % 8 = 0 then 'new' else category end as category from g_picture")
def patch_picture(t: Tables) -> DataFrame:
    base = t.pictures.select("id", "name", "introduction", "category")
    changes = base.where("id % 4 = 0").select("id", F.concat(F.lit("patched "), "id").alias("name"), F.when(F.col("id") % 8 == 0, F.lit("new")).alias("category"))
    return mutate.patch(base, changes)


@query("g_picture", "select id, case when spaceId = 3 then 1 else isDelete end as isDelete from g_picture")
def soft_delete(t: Tables) -> DataFrame:
    return mutate.soft_delete(t.pictures.select("id", "isDelete"), t.pictures.where("spaceId = 3").select("id"))


@query("g_space_user", "select id, spaceId, userId from g_space_user where spaceRole <> 'viewer'")
def hard_delete_member(t: Tables) -> DataFrame:
    return mutate.hard_delete(t.members.select("id", "spaceId", "userId"), t.members.where("spaceRole = 'viewer'").select("id"))


@query(
    "g_space g_picture",
    """select s.id, coalesce(sum(p.picSize * case when p.isDelete = 1 then -1 else 1 end), 0)::bigint as totalSize, coalesce(sum(case when p.isDelete = 1 then -1 when p.id is not null then 1 end), 0)::bigint as totalCount
    from g_space s left join g_picture p on p.spaceId = s.id group by s.id""",
)
def usage_deltas(t: Tables) -> DataFrame:
    base = t.spaces.select("id", F.lit(0).cast("bigint").alias("totalSize"), F.lit(0).cast("bigint").alias("totalCount"))
    sign = F.when(F.col("isDelete") == 1, -1).otherwise(1)
    return mutate.apply_deltas(base, t.pictures.where("spaceId is not null").select(F.col("spaceId").alias("id"), (F.col("picSize") * sign).alias("size"), sign.alias("count")))


@query("g_user", "select id, userAccount, userName, userAvatar, userProfile, userRole, createTime from g_user where isDelete = 0")
def view_user(t: Tables) -> DataFrame:
    return enrich.user_view(live(t.users))


@query("g_user", "select id, userAccount, userName, userAvatar, userProfile, userRole, createTime, updateTime from g_user where isDelete = 0 and id = 8")
def view_login(t: Tables) -> DataFrame:
    return enrich.login_view(live(t.users).where("id = 8"))


@query("g_picture", "select id, name, thumbnailUrl, picScale, picFormat, userId, spaceId, createTime, editTime, updateTime, array_to_string(cast(tags::json as varchar[]), '|') as tagText from g_picture where isDelete = 0")
def view_picture(t: Tables) -> DataFrame:
    return enrich.picture_view(live(t.pictures)).select("id", "name", "thumbnailUrl", "picScale", "picFormat", "userId", "spaceId", "createTime", "editTime", "updateTime", F.array_join("tagList", "|").alias("tagText"))


@query("g_picture", "select id, tags from g_picture where isDelete = 0")
def view_picture_back(t: Tables) -> DataFrame:
    return enrich.picture_row(enrich.picture_view(live(t.pictures))).select("id", "tags")


@query("g_space", "select id, userId, spaceName, spaceLevel, spaceType, maxSize, maxCount, createTime, editTime, updateTime from g_space where isDelete = 0")
def view_space(t: Tables) -> DataFrame:
    return enrich.space_view(live(t.spaces))


@query("g_user", "select id, md5(concat('pepper', userAccount)) as hash from g_user")
def fn_hash(t: Tables) -> DataFrame:
    return t.users.select("id", fn.salted_md5(F.col("userAccount"), "pepper").alias("hash"))


@query("g_picture", "select id, round(picWidth * 1.0::double / picHeight, 2) as ratio from g_picture")
def fn_ratio(t: Tables) -> DataFrame:
    return t.pictures.select("id", fn.ratio(F.col("picWidth").cast("double"), F.col("picHeight").cast("double")).alias("ratio"))


@query("g_picture", "select id, split_part(url, '?', 1) as link from g_picture")
def fn_url_strip(t: Tables) -> DataFrame:
    return t.pictures.select("id", fn.without_query(F.col("url")).alias("link"))


@query(
    "g_picture",
    """select id, concat('/', case when spaceId is null then concat('public/', userId) else concat('space/', spaceId) end, '/', strftime(createTime, '%Y-%m-%d'), '_', substring(md5(name), 1, 16), '.', picFormat) as path from g_picture""",
)
def fn_path(t: Tables) -> DataFrame:
    return t.pictures.select("id", fn.upload_path(F.col("spaceId"), F.col("userId"), F.col("createTime"), F.col("name"), F.col("picFormat")).alias("path"))


@query("g_picture", "select id, concat(id - 1, '.webp') as compressed, concat(id - 1, '_thumbnail.png') as thumbnail from g_picture")
def fn_renditions(t: Tables) -> DataFrame:
    compressed, thumbnail = fn.renditions(fn.without_query(F.col("url")))
    return t.pictures.select("id", compressed.alias("compressed"), thumbnail.alias("thumbnail"))


@query(
    "g_picture",
    """select id, case when s = 0 then '未知' when s < 1024 then concat(s, ' B') when s < 1048576 then printf('%.2f KB', floor(s / 1024.0::double * 100 + 0.5) / 100) else printf('%.2f MB', floor(s / 1048576.0::double * 100 + 0.5) / 100) end as size,
    printf('%.2f KB', floor(picSize / 1024.0::double * 100 + 0.5) / 100) as kb from (select id, picSize, case id % 4 when 0 then 0 when 1 then picSize % 1024 when 2 then picSize else picSize * 16 end as s from g_picture)""",
)
def fn_human_size(t: Tables) -> DataFrame:
    k, size = F.col("id") % 4, F.col("picSize")
    s = F.when(k == 0, 0).when(k == 1, size % 1024).when(k == 2, size).otherwise(size * 16)
    return t.pictures.select("id", fn.human_size(s).alias("size"), fn.kilobytes(size).alias("kb"))


@query("g_picture", "select id, case reviewStatus when 0 then '待审核' when 1 then '通过' when 2 then '拒绝' end as status, case id % 4 when 0 then '普通版' when 1 then '专业版' when 2 then '旗舰版' end as level from g_picture")
def fn_labels(t: Tables) -> DataFrame:
    return t.pictures.select("id", fn.label(F.col("reviewStatus"), cat.REVIEW_STATES).alias("status"), fn.label(F.col("id") % 4, cat.LEVELS).alias("level"))


@query("g_picture", "select id, strftime(createTime, '%Y-%m-%d %H:%M:%S') as created from g_picture")
def fn_ts_format(t: Tables) -> DataFrame:
    return t.pictures.select("id", fn.stamp(F.col("createTime")).alias("created"))


@query("g_picture", "select id, len(cast(tags::json as varchar[]))::int as n, cast(tags::json as varchar[])[1] as first from g_picture where tags is not null")
def fn_json_tags(t: Tables) -> DataFrame:
    tags = F.from_json("tags", "array<string>")
    return t.pictures.where("tags is not null").select("id", F.size(tags).alias("n"), F.get(tags, F.lit(0)).alias("first"))


@query("g_picture", """select id, concat('{"code":0,"data":{"id":"', id, '","name":"', name, '"},"message":"ok"}') as body from g_picture where isDelete = 0""")
def fn_envelope(t: Tables) -> DataFrame:
    return live(t.pictures).select("id", fn.envelope(F.struct(F.col("id").cast("string").alias("id"), "name")).alias("body"))


@query("g_picture", "select id, case id % 4 when 0 then 'picture' when 1 then 'spaceUser' when 2 then 'space' end as kind from g_picture")
def fn_entity(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/api/"), F.element_at(F.array(*map(F.lit, ("picture", "spaceUser", "space", "file"))), (F.col("id") % 4 + 1).cast("int")), F.lit("/get"))
    return t.pictures.select("id", fn.entity_of(path).alias("kind"))


@query("g_user", "select u.id, m.path from g_user u cross join (values ('/'), ('/admin/users'), ('/space/1')) m(path) where u.isDelete = 0 and (m.path not like '/admin%' or u.userRole = 'admin')")
def menu_entries(t: Tables) -> DataFrame:
    rows = live(t.users).select("id", "userRole", F.explode(F.array(*map(F.lit, ("/", "/admin/users", "/space/1")))).alias("path"))
    return rows.where(menu_visible("path", "userRole")).select("id", "path")


@query("g_picture", "select id, array_to_string(list_filter([case when id % 2 = 0 then 'a' end, case when id % 3 = 0 then 'b' end, case when id % 5 = 0 then 'c' end], lambda x: x is not null), ',') as chosen from g_picture")
def tag_mask(t: Tables) -> DataFrame:
    mask = F.array(*[F.col("id") % k == 0 for k in (2, 3, 5)])
    return t.pictures.select("id", F.array_join(masked(F.array(*map(F.lit, "abc")), mask), ",").alias("chosen"))


_LINKS = """links as (select page_id, (i - 1)::int as place, split_part(l[i], '?', 1) as link from (select page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) as l from pages),
    lateral (select unnest(range(1, len(l) + 1)) as i) where trim(split_part(l[i], '?', 1)) <> '')"""


@query("", f"with {_LINKS} select * from links")
def html_links(t: Tables) -> DataFrame:
    return ingest.links(t.pages)


@query("", f"with {_LINKS} select page_id, n::int as n, concat('page', n) as name, link from (select *, row_number() over (partition by page_id order by place) as n from links) where n <= 10")
def ingest_named_links(t: Tables) -> DataFrame:
    return ingest.named(ingest.links(t.pages), "page", 10)


@query("", f"with {_LINKS} select count(*) as total from (select row_number() over (partition by page_id order by place) as n from links) where n <= 10")
def ingest_count(t: Tables) -> DataFrame:
    return paging.total(ingest.named(ingest.links(t.pages), "page", 10))


_LOCK = """msgs as (select *, row_number() over (partition by pictureId order by seq) as n from g_ev where type <> 'BOGUS'),
    walk(pictureId, seq, userId, type, editAction, n, holder, good) as (
    select pictureId, seq, userId, type, editAction, n, case when type = 'ENTER_EDIT' then userId end, type = 'ENTER_EDIT' from msgs where n = 1
    union all select m.pictureId, m.seq, m.userId, m.type, m.editAction, m.n,
    case when m.type = 'ENTER_EDIT' and w.holder is null then m.userId when m.type = 'EXIT_EDIT' and w.holder = m.userId then null else w.holder end,
    coalesce((m.type = 'ENTER_EDIT' and w.holder is null) or (m.type = 'EXIT_EDIT' and w.holder = m.userId) or (m.type = 'EDIT_ACTION' and w.holder = m.userId and m.editAction <> 'NOPE'), false)
    from msgs m join walk w on m.pictureId = w.pictureId and m.n = w.n + 1),
    done as (select pictureId, seq, userId, type, editAction from walk where good)"""


def _recursive(sql: str) -> str:
    return cat.with_tables("g_ev").replace("with ", "with recursive ", 1) + f", {_LOCK} {sql}"


@query("", _recursive("select * from done"))
def edit_lock_batch(t: Tables) -> DataFrame:
    return collab.accepted(t.messages)


#: The last JOIN or LEAVE of each session in a picture before each message.
_ROOM = """rooms as (select d.pictureId, d.seq, d.userId, d.type, s.userId as receiver, arg_max(s.type, s.moment) as last from done d join g_session s on s.pictureId = d.pictureId and s.moment < d.seq * 4 + 1
    group by d.pictureId, d.seq, d.userId, d.type, s.userId), sent as (select * from rooms where last = 'JOIN' and (type <> 'EDIT_ACTION' or receiver <> userId))"""


def _rooms(sql: str) -> str:
    return cat.with_tables("g_ev", "g_session").replace("with ", "with recursive ", 1) + f", {_LOCK}, {_ROOM} {sql}"


@query("", _rooms("select pictureId, seq, receiver from sent"))
def edit_fanout(t: Tables) -> DataFrame:
    return collab.fan_out(collab.accepted(t.messages), t.log).select("pictureId", "seq", "receiver")


@query("", _rooms("select d.pictureId, d.type, count(s.receiver) as receivers from done d left join sent s on s.pictureId = d.pictureId and s.seq = d.seq group by d.pictureId, d.type"))
def edit_fanout_counts(t: Tables) -> DataFrame:
    return collab.receivers(collab.accepted(t.messages), t.log).groupBy("pictureId", "type").agg(F.sum("receivers").alias("receivers"))


@query(
    "g_ev",
    """select seq, kind, case when kind in ('INFO', 'ERROR') then 'ERROR' end as answer, kind is null or kind = 'BOGUS' as fails from
    (select seq, case when type <> 'BOGUS' then type when seq % 4 = 0 then 'INFO' when seq % 4 = 1 then 'ERROR' when seq % 4 = 2 then 'BOGUS' end as kind from g_ev)""",
)
def edit_rejected(t: Tables) -> DataFrame:
    unknown = F.when(F.col("seq") % 4 == 0, F.lit("INFO")).when(F.col("seq") % 4 == 1, F.lit("ERROR")).when(F.col("seq") % 4 == 2, F.lit("BOGUS"))
    rows = t.messages.select("seq", F.when(F.col("type") != "BOGUS", F.col("type")).otherwise(unknown).alias("kind"))
    return rows.select("seq", "kind", collab.answer(F.col("kind")).alias("answer"), collab.fails(F.col("kind")).alias("fails"))


@query(
    "g_session",
    """select pictureId, moment, count(*) filter (where last = 'JOIN')::bigint as open from (select m.pictureId, m.moment, s.userId, arg_max(s.type, s.moment) as last from g_session m
    join g_session s on s.pictureId = m.pictureId and s.moment <= m.moment group by m.pictureId, m.moment, s.userId) group by pictureId, moment""",
)
def session_concurrency(t: Tables) -> DataFrame:
    return collab.sessions(t.log)


@query(
    "",
    cat.with_tables("g_ev", "g_session", "g_user").replace("with ", "with recursive ", 1)
    + f""", {_LOCK} select x.pictureId, x.moment, case x.type when 'JOIN' then concat(u.userName, '加入编辑') when 'LEAVE' then concat(u.userName, '离开编辑') when 'ENTER_EDIT' then concat(u.userName, '开始编辑图片')
    when 'EXIT_EDIT' then concat(u.userName, '退出编辑图片') else concat(u.userName, '执行', case x.editAction when 'ZOOM_IN' then '放大操作' when 'ZOOM_OUT' then '缩小操作' when 'ROTATE_LEFT' then '左旋操作' else '右旋操作' end) end as text
    from (select pictureId, userId, moment, type, null as editAction from g_session union all select pictureId, userId, seq * 4 + 1, type, editAction from done) x join g_user u on u.id = x.userId and u.isDelete = 0""",
)
def edit_notices(t: Tables) -> DataFrame:
    done = collab.accepted(t.messages).select("pictureId", "userId", (F.col("seq") * 4 + 1).alias("moment"), "type", "editAction")
    every = t.log.select("pictureId", "userId", "moment", "type", F.lit(None).cast("string").alias("editAction")).unionByName(done)
    names = live(t.users).select(F.col("id").alias("userId"), "userName")
    return every.join(names, "userId").select("pictureId", "moment", collab.notice(F.col("type"), F.col("userName"), F.col("editAction")).alias("text"))


def edit_lock_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the events file, run to its end into a table of accepted messages."""
    return collab.run_stream(cat.stream(spark, sf_dir, "g_ev"), shared_folder(spark, "edit-lock"))


_QUERIES["edit_lock_stream"] = edit_lock_stream
_SQL["edit_lock_stream"] = _recursive("select * from done")


#: Sessions and lock together: the walk of a picture's messages, and the last JOIN or DISCONNECT of each session before each event that goes out.
_ROOM_WALK = """msgs as (select *, row_number() over (partition by pictureId order by moment) as n from g_room where type not in ('BOGUS', 'JOIN')),
    walk(pictureId, moment, type, userId, n, holder, good) as (
    select pictureId, moment, type, userId, n, case when type = 'ENTER_EDIT' then userId end, type = 'ENTER_EDIT' from msgs where n = 1
    union all select m.pictureId, m.moment, m.type, m.userId, m.n,
    case when m.type = 'ENTER_EDIT' and w.holder is null then m.userId when m.type in ('EXIT_EDIT', 'DISCONNECT') and w.holder = m.userId then null else w.holder end,
    coalesce((m.type = 'ENTER_EDIT' and w.holder is null) or (m.type in ('EXIT_EDIT', 'DISCONNECT') and w.holder = m.userId) or (m.type = 'EDIT_ACTION' and w.holder = m.userId and m.editAction <> 'NOPE'), false)
    from msgs m join walk w on m.pictureId = w.pictureId and m.n = w.n + 1),
    went as (select r.pictureId, r.moment, r.userId, r.sessionId, r.type, r.editAction, coalesce(w.good and r.type in ('EXIT_EDIT', 'DISCONNECT'), false) as released
    from g_room r left join walk w on w.pictureId = r.pictureId and w.moment = r.moment where r.type in ('JOIN', 'DISCONNECT') or w.good),
    tabs as (select w.pictureId, w.moment, w.sessionId, w.type, s.sessionId as receiver, arg_max(s.type, s.moment) as last from went w
    join g_room s on s.pictureId = w.pictureId and s.moment <= w.moment and s.type in ('JOIN', 'DISCONNECT') group by w.pictureId, w.moment, w.sessionId, w.type, s.sessionId),
    inside as (select *, type <> 'EDIT_ACTION' or receiver <> sessionId as sent from tabs where last = 'JOIN')"""


def _room_sql(sql: str) -> str:
    return cat.with_tables("g_room").replace("with ", "with recursive ", 1) + f", {_ROOM_WALK} {sql}"


_HAPPENED = """select w.pictureId, w.moment, w.userId, w.sessionId, w.type, w.editAction, w.released, coalesce(n.open, 0)::bigint as open, coalesce(n.receivers, 0)::bigint as receivers from went w
    left join (select pictureId, moment, count(*) as open, count(*) filter (where sent) as receivers from inside group by pictureId, moment) n on n.pictureId = w.pictureId and n.moment = w.moment"""


@query("", _room_sql(_HAPPENED))
def room_events(t: Tables) -> DataFrame:
    return room.batch(t.rooms)


def room_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms as a stream over the events file."""
    return room.run_here(cat.stream(spark, sf_dir, "g_room"), "1 hour")


def room_fanout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers of each event of a room, from the sessions that the stream keeps."""
    return room.run_here(cat.stream(spark, sf_dir, "g_room"), "1 hour", fan=True)


_QUERIES |= {"room_stream": room_stream, "room_fanout_stream": room_fanout_stream}
_SQL |= {"room_stream": _room_sql(_HAPPENED), "room_fanout_stream": _room_sql("select pictureId, moment, sessionId, type, receiver from inside where sent")}


#: Who asks to join: every JOIN; every third asks for the picture before the one of its room, to meet those of spaces.
_HANDSHAKE_ASKS = "asks as (select moment, userId, case when moment % 7 = 0 then null when moment % 3 = 0 then pictureId * 2 + userId else pictureId end as pictureId from g_room where type = 'JOIN')"
_HANDSHAKES = f""", {_HANDSHAKE_ASKS} select a.moment, a.userId, a.pictureId, case when a.pictureId is null then 'picture_id' when u.id is null then 'login' when p.id is null then 'picture'
    when p.spaceId is not null and s.id is null then 'space' when p.spaceId is not null and s.spaceType <> 1 then 'team'
    when case when p.spaceId is null then u.userRole = 'admin' else coalesce(m.spaceRole in ('editor', 'admin'), false) end then null else 'permission' end as refused
    from asks a left join (select * from g_user where isDelete = 0) u on u.id = a.userId left join (select * from g_picture where isDelete = 0) p on p.id = a.pictureId
    left join (select * from g_space where isDelete = 0) s on s.id = p.spaceId left join g_space_user m on m.spaceId = p.spaceId and m.userId = a.userId"""


def _handshake_asks(rows: DataFrame) -> DataFrame:
    return rows.where("type = 'JOIN'").selectExpr("moment", "userId", "case when moment % 7 = 0 then null when moment % 3 = 0 then pictureId * 2 + userId else pictureId end as pictureId")


@query("g_room g_user g_picture g_space g_space_user", _HANDSHAKES)
def handshake(t: Tables) -> DataFrame:
    return permissions.handshakes(_handshake_asks(t.rooms), t.users, t.pictures, t.spaces, t.members)


def handshake_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream of asks; every micro-batch meets the tables as they are then."""

    def told(asks: DataFrame) -> DataFrame:
        t = Tables(spark, sf_dir)
        return permissions.handshakes(asks, t.users, t.pictures, t.spaces, t.members)

    return batches.run(_handshake_asks(cat.stream(spark, sf_dir, "g_room")), shared_folder(spark, "handshakes"), told)


def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage kept up from a stream of pictures that are added and, some of them, deleted again."""
    pictures = cat.stream(spark, sf_dir, "g_picture")
    changes = pictures.select("spaceId", "picSize", F.explode(F.when(F.col("isDelete") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("added"))
    return batches.keep_usage(changes, shared_folder(spark, "usage"))


_QUERIES |= {"handshake_stream": handshake_stream, "usage_stream": usage_stream}
_SQL |= {
    "handshake_stream": cat.with_tables("g_room", "g_user", "g_picture", "g_space", "g_space_user") + _HANDSHAKES,
    "usage_stream": cat.with_tables("g_picture") + """ select spaceId as id, sum(case when isDelete = 0 then picSize else 0 end)::bigint as totalSize, count(*) filter (where isDelete = 0) as totalCount
    from g_picture where spaceId is not null group by spaceId""",
}


@query("g_space", "select id, userId, spaceName, spaceLevel, spaceType from g_space where isDelete = 0")
def view_space_back(t: Tables) -> DataFrame:
    return enrich.space_row(enrich.with_user(enrich.space_view(live(t.spaces)), t.users)).select("id", "userId", "spaceName", "spaceLevel", "spaceType")


@query("g_space_user", "select id, spaceId, userId, spaceRole from g_space_user")
def view_member(t: Tables) -> DataFrame:
    return enrich.member_view(t.members)


@query("g_space_user", "select id, spaceId, userId, spaceRole from g_space_user")
def view_member_back(t: Tables) -> DataFrame:
    return enrich.member_row(enrich.members(enrich.member_view(t.members), t.users, t.spaces))


@query("g_space g_user", "select s.id, u.userName from g_space s left join (select * from g_user where isDelete = 0) u on s.userId = u.id and s.userId > 0 where s.isDelete = 0 and s.id = 5")
def enrich_single_space(t: Tables) -> DataFrame:
    return enrich.with_user(live(t.spaces).where("id = 5"), t.users, enrich.positive("userId")).select("id", F.col("user.userName").alias("userName"))


@query("g_user", "select id, userRole = 'admin' as admin_gate, true as open_gate from g_user where isDelete = 0")
def site_gate(t: Tables) -> DataFrame:
    return live(t.users).select("id", permissions.site_gate("admin").alias("admin_gate"), permissions.site_gate(None).alias("open_gate"))


@query("g_space_user", "select id, case when id % 7 = 0 then 40000 else 0 end as code from g_space_user")
def validate_member_change(t: Tables) -> DataFrame:
    rows = t.members.withColumn("spaceRole", F.when(F.col("id") % 7 == 0, F.lit("owner")).when(F.col("id") % 5 != 0, F.col("spaceRole")))
    return rules.member_errors(rows, t.users, t.spaces, add=False).select("id", "code")


@query("g_space", "select id, case when id % 3 = 0 then '默认空间' else spaceName end as spaceName, case when id % 2 = 0 then 0 else spaceLevel end as spaceLevel, case when id % 5 = 0 then 0 else spaceType end as spaceType from g_space")
def space_defaults(t: Tables) -> DataFrame:
    asked = t.spaces.select(
        "id",
        F.when(F.col("id") % 3 != 0, F.col("spaceName")).when(F.col("id") % 6 == 0, F.lit("  ")).alias("spaceName"),
        F.when(F.col("id") % 2 != 0, F.col("spaceLevel")).alias("spaceLevel"),
        F.when(F.col("id") % 5 != 0, F.col("spaceType")).alias("spaceType"),
    )
    return asked.withColumns(rules.space_defaults())


_AT = "2026-01-02 03:04:05"


@query(
    "g_picture",
    f"""select id, case when d and code = 0 then target else reviewStatus end as reviewStatus, case when d and code = 0 then concat('note ', id) end as reviewMessage, case when d and code = 0 then 1::bigint end as reviewerId,
    case when d and code = 0 then '{_AT}' end as reviewTime, case when d then code end as code from (select id, reviewStatus, (id % 4)::int as target, id % 2 = 0 or id % 3 = 0 as d,
    case when id % 4 not in (1, 2) then 40000 when reviewStatus = id % 4 then 40000 else 0 end as code from g_picture where isDelete = 0)""",
)
def review_stamped(t: Tables) -> DataFrame:
    rows = live(t.pictures).select("id", "reviewStatus")
    decisions = rows.where("id % 2 = 0 or id % 3 = 0").select("id", (F.col("id") % 4).cast("int").alias("status"), F.concat(F.lit("note "), "id").alias("message"), F.lit(1).cast("bigint").alias("reviewer"))
    return rules.reviewed(rows, decisions, fn.stamp(F.lit(_AT).cast("timestamp")))


_UPLOADS = """asks as (select p.id as ask, p.userId as asker, u.userRole = 'admin' as asker_admin, p.picSize, case p.id % 4 when 0 then null when 1 then p.spaceId when 2 then p.userId else p.id % 140 + 1 end as spaceId,
    case p.id % 3 when 0 then null when 1 then p.id else p.id + 1 end as pictureId from g_picture p join g_user u on p.userId = u.id where u.isDelete = 0)"""


@query(
    "g_user g_space g_picture",
    f""", {_USED}, {_UPLOADS}, told as (select a.ask, a.asker, a.asker_admin, a.picSize, a.pictureId, coalesce(a.spaceId, o.spaceId) as spaceId, case when a.spaceId is not null and s.id is null then 40400
    when a.spaceId is not null and s.userId <> a.asker then 40101 when a.spaceId is not null and n.totalCount >= n.maxCount then 50001 when a.spaceId is not null and n.totalSize >= n.maxSize then 50001
    when a.pictureId is not null and o.id is null then 40400 when a.pictureId is not null and o.userId <> a.asker and not a.asker_admin then 40101
    when a.pictureId is not null and a.spaceId is not null and a.spaceId is distinct from o.spaceId then 40000 else 0 end as code
    from asks a left join (select * from g_space where isDelete = 0) s on a.spaceId = s.id left join used n on n.id = s.id left join (select * from g_picture where isDelete = 0) o on a.pictureId = o.id)
    select ask, code, case when pictureId is null then 'insert' else 'replace' end as action, spaceId, case when spaceId is null then concat('public/', asker) else concat('space/', spaceId) end as prefix,
    case when pictureId is not null then '{_AT}' end as editTime, case when spaceId is null and not asker_admin then 0 else 1 end as newStatus,
    case when code = 0 and spaceId is not null then picSize else 0 end::bigint as sizeDelta, case when code = 0 and spaceId is not null then 1 else 0 end::bigint as countDelta from told""",
)
def upload_decision(t: Tables) -> DataFrame:
    users = live(t.users).select(F.col("id").alias("asker"), (F.col("userRole") == "admin").alias("asker_admin"))
    i = F.col("id")
    asks = t.pictures.select(
        i.alias("ask"),
        F.col("userId").alias("asker"),
        "picSize",
        F.when(i % 4 == 1, F.col("spaceId")).when(i % 4 == 2, F.col("userId")).when(i % 4 == 3, i % 140 + 1).alias("spaceId"),
        F.when(i % 3 == 1, i).when(i % 3 == 2, i + 1).alias("pictureId"),
    ).join(users, "asker")
    return rules.upload_decisions(asks, _used(t), t.pictures, fn.stamp(F.lit(_AT).cast("timestamp"))).select("ask", "code", "action", "spaceId", "prefix", "editTime", "newStatus", "sizeDelta", "countDelta")


_CONTEXTS = """asks as (select id as asker, userRole = 'admin' as asker_admin, case when id % 7 = 1 then case id % 3 when 0 then 'viewer' when 1 then 'editor' else 'admin' end end as memberRole,
    case when id % 7 in (1, 2) then id * 4 % 9000 + 1 end as spaceUserId, case when id % 7 in (3, 5) then id % 14 + 1 when id % 7 = 6 then id end as spaceId, case when id % 7 in (4, 5) then id * 3 % 9000 + 1 end as pictureId
    from g_user where isDelete = 0)"""


@query(
    "g_user g_space g_space_user g_picture",
    f""", {_CONTEXTS}, met as (select a.*, tm.id as membership, tm.spaceId as memberSpace, p.id as picture, p.spaceId as pictureSpace, p.userId as pictureOwner,
    case when a.spaceUserId is not null then tm.spaceId when a.spaceId is not null then a.spaceId else p.spaceId end as atSpace from asks a left join g_space_user tm on a.spaceUserId = tm.id
    left join (select * from g_picture where isDelete = 0) p on a.pictureId = p.id)
    select a.asker, case when a.memberRole is not null then {_ROLE_LIST.format(r="a.memberRole")} when a.spaceUserId is not null then case when a.membership is null then null else {_ROLE_LIST.format(r="m.spaceRole")} end
    when a.spaceId is null and a.pictureId is null then {_ADMIN_LIST} when a.spaceId is null and a.picture is null then null
    when a.spaceId is null and a.pictureSpace is null then case when a.pictureOwner = a.asker or a.asker_admin then {_ADMIN_LIST} else 'picture:view' end when s.id is null then null {_SPACE_CASE} as permissions,
    case when a.memberRole is not null then 0 when a.spaceUserId is not null then case when a.membership is null then 40400 else 0 end when a.spaceId is null and a.pictureId is null then 0
    when a.spaceId is null and a.picture is null then 40400 when a.spaceId is null and a.pictureSpace is null then 0 when s.id is null then 40400 else 0 end as code
    from met a left join (select * from g_space where isDelete = 0) s on a.atSpace = s.id left join g_space_user m on m.spaceId = a.atSpace and m.userId = a.asker""",
)
def perm_any_context(t: Tables) -> DataFrame:
    i = F.col("id")
    role = F.when(i % 3 == 0, F.lit("viewer")).when(i % 3 == 1, F.lit("editor")).otherwise(F.lit("admin"))
    asks = live(t.users).select(
        i.alias("asker"),
        (F.col("userRole") == "admin").alias("asker_admin"),
        F.when(i % 7 == 1, role).alias("memberRole"),
        F.when((i % 7).isin(1, 2), i * 4 % 9000 + 1).alias("spaceUserId"),
        F.when((i % 7).isin(3, 5), i % 14 + 1).when(i % 7 == 6, i).alias("spaceId"),
        F.when((i % 7).isin(4, 5), i * 3 % 9000 + 1).alias("pictureId"),
    )
    return permissions.on_context(asks, t.pictures, t.spaces, t.members).select("asker", F.array_join("permissions", ",").alias("permissions"), "code")


@query("", "select page_id, concat('in-', page_id, '.png') as link from pages")
def html_scoped_images(t: Tables) -> DataFrame:
    """img.mimg in the first .dgControl, in which the page stands too; others stand before and after it."""
    inside = F.concat(F.lit("<SECTION class='x dgControl'>"), "html", F.lit("<p><img class='mimg a' src=in-"), "page_id", F.lit(".png?w=1></p><img src=\"other.png\"></SECTION>"))
    pages = t.pages.select("page_id", F.concat(F.lit('<img class="mimg" src="before.png">'), inside, F.lit('<img class="mimg" src="after.png">')).alias("html"))
    return ingest.links(pages, "img", "src", "mimg", "dgControl").select("page_id", "link")


@query("", f"with {_LINKS} select * from links")
def html_scoped_links(t: Tables) -> DataFrame:
    """Links of the pages, each set into the first of two .dgControl elements among others that do not count."""
    outer = F.concat(F.lit("<a href=/before></a><SECTION class='x dgControl'>"), "html", F.lit("</SECTION><a href=/after></a><div class=dgControl><a href=/second></a></div>"))
    return ingest.links(t.pages.select("page_id", outer.alias("html")), container="dgControl")


@query("g_picture", "select id, name from g_picture where isDelete = 0 order by createTime desc nulls last, id limit 20 offset 780")
def page_deep(t: Tables) -> DataFrame:
    return paging.deep(live(t.pictures), Page(40, 20, "createTime")).select("id", "name")


@query("g_picture", f"select id, name, (select count(*) from g_picture where {_LIVE_PUBLIC}) as total from g_picture where {_LIVE_PUBLIC} order by createTime desc nulls last, id limit 12")
def page_and_total_public(t: Tables) -> DataFrame:
    """A page and the number of all its rows from one scan."""
    return paging.page_and_total(live(t.pictures).where(public_visible()), Page(1, 12, "createTime")).select("id", "name", "total")


@query(
    "g_user g_space g_space_user g_picture",
    f""", {_ASKS}, met as (select a.spaceId, a.asker, case when s.id is null then 40400 when s.spaceType = 0 then case when s.userId = a.asker or a.asker_admin then 0 else 40101 end when m.spaceRole is null then 40101 else 0 end as code from {_MET} where a.spaceId is not null),
    ranked as (select spaceId, id, row_number() over (partition by spaceId order by createTime desc nulls last, id) as n from g_picture where isDelete = 0 and reviewStatus = 1 and spaceId is not null)
    select met.spaceId, asker, code, p.id from met left join (select * from ranked where n <= 3) p on p.spaceId = met.spaceId and met.code = 0""",
)
def page_space_allowed(t: Tables) -> DataFrame:
    """First pictures of the spaces that users ask for, for those who may view them, and an error code for others."""
    asks = permissions.on_space(_asks(t).where("spaceId is not null"), t.spaces, t.members)
    may = permissions.has("permissions", [permissions.VIEW])
    there = live(t.spaces).select(F.col("id").alias("_live"))
    told = asks.join(there, F.col("spaceId") == F.col("_live"), "left").withColumn("code", rules.first_error((F.col("_live").isNull(), rules.NOT_FOUND), (~may, rules.NO_AUTH)))
    shown = live(t.pictures).where((F.col("reviewStatus") == cat.PASS) & F.col("spaceId").isNotNull())
    first = paging.first_of_each(shown, "spaceId", Page(1, 3, "createTime")).select(F.col("spaceId").alias("_of"), "id")
    return told.join(first, (F.col("spaceId") == F.col("_of")) & (F.col("code") == rules.OK), "left").select("spaceId", "asker", "code", "id")


_FAILS = "not regexp_matches(link, '^/[A-Za-z]+$')"


@query(
    "",
    f"""with {_LINKS}, tried as (select page_id, place, link, {_FAILS} as failed, coalesce(sum(case when {_FAILS} then 0 else 1 end) over (partition by page_id order by place rows between unbounded preceding and 1 preceding), 0) as done
    from links) select page_id, place, concat('page', done + 1) as name, link, not failed as uploaded from tried where done < 4""",
)
def ingest_attempts(t: Tables) -> DataFrame:
    return ingest.attempted(ingest.links(t.pages), ~F.col("link").rlike("^/[A-Za-z]+$"), "page", 4)


#: Uploads of one batch: a third go to one space, one in ten is asked for by another user than the owner.
_BATCH = """asks as (select p.id as ask, case when p.id % 10 = 0 then p.userId else s.own end as asker, false as asker_admin, s.own as spaceId, case when p.id % 21 = 5 then p.id end as pictureId, p.picSize * 20 as picSize
    from g_picture p cross join lateral (select case when p.id % 3 = 0 then 2 when p.id % 6 = 1 then null else p.id % 40 + 1 end as own) s), facts as (
    select a.ask, a.spaceId, a.picSize, coalesce(a.spaceId, o.spaceId) as place, case when a.spaceId is not null and n.id is null then 40400 when a.spaceId is not null and s.userId <> a.asker then 40101 else 0 end as early,
    case when a.pictureId is not null and o.id is null then 40400 when a.pictureId is not null and o.userId <> a.asker then 40101 when a.pictureId is not null and a.spaceId is not null and a.spaceId is distinct from o.spaceId then 40000 else 0 end as late
    from asks a left join used n on n.id = a.spaceId left join g_space s on s.id = n.id left join (select * from g_picture where isDelete = 0) o on a.pictureId = o.id),
    lined as (select f.*, n.totalCount as c0, n.totalSize as s0, n.maxCount, n.maxSize, row_number() over (partition by f.place order by f.ask) as i from facts f left join used n on n.id = f.place where f.place is not null),
    walk(place, i, ask, c, s, code) as (
    select place, 0::bigint, null::bigint, max(c0)::bigint, max(s0)::bigint, 0 from lined group by place
    union all select l.place, l.i, l.ask, case when d.code = 0 then w.c + 1 else w.c end, (case when d.code = 0 then w.s + l.picSize else w.s end)::bigint, d.code from walk w join lined l on l.place = w.place and l.i = w.i + 1,
    lateral (select case when l.early <> 0 then l.early when l.spaceId is not null and (w.c >= l.maxCount or w.s >= l.maxSize) then 50001 else l.late end as code) d)"""


@query("", cat.with_tables("g_user", "g_space", "g_picture").replace("with ", "with recursive ", 1) + f", {_USED}, {_BATCH} select ask, code from walk where ask is not null union all select ask, late from facts where place is null")
def upload_admission(t: Tables) -> DataFrame:
    """Uploads of one batch in order; the checking SQL walks them one by one."""
    i = F.col("id")
    own = F.when(i % 3 == 0, F.lit(2).cast("bigint")).when(i % 6 == 1, F.lit(None).cast("bigint")).otherwise(i % 40 + 1)
    asks = t.pictures.select(
        i.alias("ask"),
        F.when(i % 10 == 0, F.col("userId")).otherwise(own).alias("asker"),
        F.lit(False).alias("asker_admin"),
        own.alias("spaceId"),
        F.when(i % 21 == 5, i).alias("pictureId"),
        (F.col("picSize") * 20).alias("picSize"),
    )
    return admission.upload_admissions(asks, _used(t), t.pictures, "ask").select("ask", "code")


@query(
    "g_user",
    """, asks as (select c_custkey as id, case when c_custkey % 5 = 0 then upper(c_name) else concat('New-', c_custkey % 40) end as account, case when c_custkey % 7 = 0 then 'p' else 'secret-word' end as password from customer),
    sound as (select *, length(password) >= 2 and not exists (select 1 from g_user u where u.isDelete = 0 and lower(u.userAccount) = lower(a.account)) as good from asks a)
    select id, case when good and not exists (select 1 from sound b where b.good and lower(b.account) = lower(s.account) and b.id < s.id) then 0 else 40000 end as code from sound s""",
)
def register_batch(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    word = F.when(k % 7 == 0, F.lit("p")).otherwise(F.lit("secret-word"))
    account = F.when(k % 5 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("New-"), (k % 40).cast("string")))
    return admission.registrations(t.customer.select(k.alias("id"), account.alias("account"), word.alias("password"), word.alias("again")), t.users, "id").select("id", "code")


_NEW_SPACES = """, asks as (select p.id as ask, u.id as asker, u.userRole = 'admin' as asker_admin, case when p.id % 4 = 0 then 1 else 0 end as lv, (p.id % 2)::int as kind from g_picture p join (select * from g_user where isDelete = 0) u on u.id = p.userId),
    sound as (select *, lv <> 0 and not asker_admin as barred, exists (select 1 from g_space s where s.isDelete = 0 and s.userId = a.asker and s.spaceType = a.kind) as has from asks a),
    lined as (select *, row_number() over (partition by asker, kind, barred or has order by ask) as n from sound),
    told as (select *, case when barred then 40101 when has or n > 1 then 50001 else 0 end as code from lined)"""


def _new_spaces(t: Tables) -> DataFrame:
    i = F.col("id")
    users = live(t.users).select(F.col("id").alias("asker"), (F.col("userRole") == "admin").alias("asker_admin"))
    asks = t.pictures.select(i.alias("ask"), F.col("userId").alias("asker"), F.when(i % 4 == 0, F.lit(1)).alias("spaceLevel"), F.when(i % 2 == 1, F.lit(1)).alias("spaceType")).join(users, "asker")
    return admission.new_spaces(asks, t.spaces, "ask")


@query("g_user g_space g_picture", f"{_NEW_SPACES} select ask, code from told")
def new_space_batch(t: Tables) -> DataFrame:
    return _new_spaces(t).select("ask", "code")


#: The moment of the batch, in milliseconds.
_NOW = 1_767_225_600_000
_CREATED = f", created as (select *, {ids.first_id(_NOW)} + row_number() over (order by ask) - 1 as id from told where code = 0)"


def _created(t: Tables) -> DataFrame:
    return ids.assigned(_new_spaces(t).where(F.col("code") == rules.OK), "ask", _NOW)


@query("g_user g_space g_picture", f"{_NEW_SPACES}{_CREATED} select id, asker as userId, lv as spaceLevel, kind as spaceType from created union all select id, userId, spaceLevel, spaceType from g_space")
def create_spaces(t: Tables) -> DataFrame:
    """The table of spaces after a batch of asks, new ones with ids of their own."""
    made = _created(t).select("id", F.col("asker").alias("userId"), F.coalesce("spaceLevel", F.lit(0)).alias("spaceLevel"), F.coalesce("spaceType", F.lit(0)).alias("spaceType"))
    return mutate.insert(t.spaces.select("id", "userId", "spaceLevel", "spaceType"), made)


@query("g_user g_space g_picture", f"{_NEW_SPACES}{_CREATED} select id as spaceId, asker as userId, 'admin' as spaceRole from created where kind = 1")
def create_space_admins(t: Tables) -> DataFrame:
    """The memberships that come with the new team spaces."""
    return admission.team_admins(_created(t), F.col("id"))


@query(
    "g_picture",
    """select id, case when id % 500 = 2 then concat('patched ', id) when id % 900 = 5 then 'again' else name end as name, case when id % 1000 = 2 then 'new' else category end as category, case when id % 700 = 3 then 1 else isDelete end as isDelete
    from g_picture where id % 800 <> 4 union all select id + 10000000, 'added', null, 0 from g_picture where id % 900 = 5""",
)
def change_folders(t: Tables) -> DataFrame:
    """A patch, an upsert and deletions of both kinds, one after the other, each of which rewrites the folders of its keys only."""
    base = t.pictures.select("id", "name", "category", "isDelete")
    path, folders = shared_folder(t.spark, "pictures"), 64
    touched.lay_out(base, path, "id", folders)
    touched.patch(path, base.schema, base.where("id % 500 = 2").select("id", F.concat(F.lit("patched "), "id").alias("name"), F.when(F.col("id") % 1000 == 2, F.lit("new")).alias("category")), folders)
    again = base.where("id % 900 = 5")
    added = again.select((F.col("id") + 10000000).alias("id"), F.lit("added").alias("name"), F.lit(None).cast("string").alias("category"), F.lit(0).alias("isDelete"))
    touched.upsert(path, base.schema, again.withColumn("name", F.lit("again")).unionByName(added), folders)
    touched.soft_delete(path, base.schema, base.where("id % 700 = 3").select("id"), folders)
    touched.hard_delete(path, base.schema, base.where("id % 800 = 4").select("id"), folders)
    return touched.read(t.spark, path, base.schema)


@query("g_space_user", "select id, spaceRole in ('editor', 'admin') or id % 5 = 0 as passed, spaceRole = 'admin' or id % 15 = 0 as passedBoth from g_space_user")
def perm_gate_or_role(t: Tables) -> DataFrame:
    """A permission, or else a role of the site: one of several, or all of a list."""
    roles = F.filter(F.array(F.when(F.col("id") % 3 == 0, F.lit("auditor")), F.when(F.col("id") % 5 == 0, F.lit("staff"))), lambda r: r.isNotNull())
    own = permissions.of_role("spaceRole")
    return t.members.select(
        "id",
        permissions.has_or_role(own, ["picture:edit"], roles, ["manager", "staff"]).alias("passed"),
        permissions.has_or_role(own, ["spaceUser:manage"], roles, ["auditor, staff"]).alias("passedBoth"),
    )


@query("g_space_user g_space", "select m.id, case m.spaceRole when 'viewer' then '浏览者' when 'editor' then '编辑者' when 'admin' then '管理员' end as role, case s.spaceType when 0 then '私有空间' when 1 then '团队空间' end as kind from g_space_user m join g_space s on s.id = m.spaceId")
def fn_role_and_type_labels(t: Tables) -> DataFrame:
    kinds = t.spaces.select(F.col("id").alias("spaceId"), "spaceType")
    return t.members.join(kinds, "spaceId").select("id", fn.label(F.col("spaceRole"), cat.ROLES).alias("role"), fn.label(F.col("spaceType"), cat.SPACE_TYPES).alias("kind"))


@query("", "select p_partkey as id, case when p_partkey % 5 = 4 then 40000 when p_partkey % 9 <> 0 and length(p_name) > 30 then 40000 when p_partkey % 3 = 2 then 40000 else 0 end as code from part")
def validate_space_change(t: Tables) -> DataFrame:
    """A change may leave name, level and type out; what is given is checked."""
    i = F.col("p_partkey")
    rows = t.part.select(i.alias("id"), F.when(i % 9 != 0, F.col("p_name")).alias("spaceName"), F.when(i % 5 != 3, (i % 5).cast("int")).alias("spaceLevel"), F.when(i % 3 != 0, (i % 3).cast("int")).alias("spaceType"))
    return rows.select("id", rules.space_error(add=False).alias("code"))


@query("g_picture", """select id, concat('{"code":0,"data":{"id":"', id, '","size":"', picSize, '","width":', picWidth, ',"owner":{"id":"', userId, '"}},"message":"ok"}') as body from g_picture where isDelete = 0""")
def fn_envelope_longs(t: Tables) -> DataFrame:
    data = F.struct("id", F.col("picSize").alias("size"), F.col("picWidth").alias("width"), F.struct(F.col("userId").alias("id")).alias("owner"))
    rows = live(t.pictures).withColumn("data", data)
    return rows.select("id", fn.envelope(fn.longs_as_text("data", rows.schema["data"].dataType)).alias("body"))


@query("g_picture", f"select id, name from g_picture where {_LIVE_PUBLIC} order by createTime desc nulls last, id limit 12")
def page_cached(t: Tables) -> DataFrame:
    """The first page of public pictures, asked for twice: the second time it comes from the cache."""
    page = lambda: paging.records(live(t.pictures).where(public_visible()), Page(1, 12, "createTime")).select("id", "name")
    folder, request = shared_folder(t.spark, "pages"), {"scope": "public", "page": 1, "size": 12}
    cached(t.spark, folder, request, page, 1000)
    return cached(t.spark, folder, request, page, 1100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
