"""Every catalogue query against its SQL on the smallest tables, and the rules of filters and pages."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spectrafold.operators import ingest, mutate, paging, rules
from spectrafold.operators.paging import Page
from spectrafold.operators.predicates import Query, live
from spectrafold.plans import registry
from spectrafold.plans.cache import cached, lifetime
from spectrafold.functions import scalars as fn

DATA = Path("/root/testdata/sf0.001")
TABLES = "customer supplier part orders events pages".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(found):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.fixture(scope="module")
def pictures(spark):
    return spark.createDataFrame(
        [(1, "a_b", "x", None, 0, '["t"]'), (2, "aXb", None, 7, 1, "no json"), (3, "ab", "A_B", 7, 1, None), (4, None, None, None, 0, "[]")],
        "id int, name string, introduction string, spaceId int, isDelete int, tags string",
    )


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_absent_arguments_leave_filters_out(pictures):
    assert ids(pictures.where(Query(equals={"name": None, "spaceId": None}, contains={"name": " "}, search="").predicate())) == [1, 2, 3, 4]
    assert ids(pictures.where(Query(equals={"isDelete": 0}).predicate())) == [1, 4]


def test_wildcards_stay_active(pictures):
    assert ids(pictures.where(Query(contains={"name": "A_B"}).predicate())) == [1, 2]
    assert ids(pictures.where(Query(search="a_b").predicate())) == [1, 2, 3]


def test_tags_and_scope(pictures):
    assert ids(pictures.where(Query(tags=["t"], typed_tags=True).predicate())) == [1]
    assert ids(pictures.where(Query(tags=["t"]).predicate())) == [1]
    assert ids(live(pictures).where(Query(public_only=True).predicate())) == [1, 4]


def test_pages(pictures):
    assert [r["id"] for r in paging.records(pictures, Page(1, 3, "name", "ascend")).collect()] == [4, 2, 1]
    assert [r["id"] for r in paging.records(pictures, Page(2, 2, "name")).collect()] == [2, 4]
    assert [r["id"] for r in paging.records(pictures, Page(9, 2)).collect()] == []
    with pytest.raises(ValueError):
        paging.guard(Page(size=21))
    with pytest.raises(ValueError):
        paging.records(pictures, Page(sort_field="id; drop"))


def test_page_plan_sorts_no_more_than_it_needs(pictures, capsys):
    paging.records(pictures, Page(2, 10, "name")).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_changes(pictures, spark):
    changes = spark.createDataFrame([(1, "new", None), (2, None, "intro")], "id int, name string, introduction string")
    out = {r["id"]: r for r in mutate.patch(pictures, changes).collect()}
    assert out[1]["name"] == "new" and out[1]["introduction"] == "x" and out[2]["name"] == "aXb" and out[2]["introduction"] == "intro"
    assert ids(mutate.hard_delete(pictures, changes.select("id"))) == [3, 4]
    assert ids(live(mutate.soft_delete(pictures, changes.select("id")))) == [4]


def test_errors_come_in_order(spark):
    df = spark.createDataFrame([(None, 9, 9), ("x" * 31, 0, 0), ("ok", 2, 1), ("ok", None, 1)], "spaceName string, spaceLevel int, spaceType int")
    assert [r[0] for r in df.select(rules.space_error(True)).collect()] == [40000, 40000, 0, 40000]
    assert [r[0] for r in df.select(rules.space_error(False)).collect()] == [40000, 40000, 0, 0]


def test_links_of_a_class_in_a_container(spark):
    html = """<img class="mimg" src="no.png"><div class="dgControl x"><br><img class='mimg a' src=yes.png?q=1><img class="other" src="other.png"><div><img src="a&amp;b.png" class=mimg /></div></div>
        <img class="mimg" src="after.png"><div class="dgControl"><img class="mimg" src="second.png"></div>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, '<div class="dgControl"'), (5, '<p class="dgControl"><img class="mimg" src="open.png">')], "page_id int, html string")
    found = ingest.links(pages, "img", "src", "mimg", "dgControl").orderBy("page_id", "place").collect()
    assert [(r["page_id"], r["link"]) for r in found] == [(1, "yes.png"), (1, "a&b.png"), (5, "open.png")]
    assert [r["name"] for r in ingest.named(ingest.links(pages.where("page_id = 1"), "img", "src"), "p", 2).orderBy("n").collect()] == ["p1", "p2"]
    with pytest.raises(ValueError):
        ingest.named(pages, "p", 31)


def test_cached_results_are_read_until_they_are_old(spark, tmp_path):
    calls = []
    ask = lambda now, request: cached(spark, f"file://{tmp_path}", request, lambda: calls.append(now) or spark.range(3), now).count()
    request = {"page": 1, "size": 3}
    life = lifetime(fn.request_key(request))
    assert 300 <= life < 600
    assert [ask(at, request) for at in (0, life - 1, life, life + 5)] == [3] * 4 and calls == [0, life]
    assert ask(life + 5, {"size": 3, "page": 1}) == 3 and calls == [0, life]
    ask(life + 5, {"page": 2, "size": 3})
    assert calls == [0, life, life + 5]


def test_null_data_stays_in_the_envelope(spark):
    assert spark.range(1).select(fn.envelope(F.lit(None).cast("string"))).first()[0] == '{"code":0,"data":null,"message":"ok"}'


def test_two_patches_of_a_row_keep_it_one_row(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id int, name string")
    assert sorted(map(tuple, mutate.patch(base, changes).collect())) == [(1, "y"), (2, "b")]


def test_empty_tables(pictures):
    none = pictures.where(F.lit(False))
    assert none.where(Query(search="a").predicate()).count() == 0
    assert paging.total(none).first()["total"] == 0
