"""Batches whose requests see each other, deep pages and single rows, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from spectrafold.operators import admission, paging
from spectrafold.operators.paging import Page


def test_sums_before_over_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3]), i, rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, v long").repartition(7)
    got = {r["i"]: (r["b"], r["n"]) for r in admission.sums_before(df.withColumn("one", F.lit(1)), "k", "i", {"b": "v", "n": "one"}).collect()}
    sums, counts = {}, {}
    for k, i, v in rows:
        assert got[i] == (sums.get(k, 0), counts.get(k, 0))
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
    assert admission.sums_before(df.where("false"), "k", "i", {"b": "v"}).count() == 0


def test_uploads_of_a_batch_walk(spark):
    """One space gets a third of all asks; quotas of count and of size, pictures to replace, foreign and missing spaces."""
    rnd = random.Random(9)
    spaces = [(s, s, 10 * s, 100 * s, 25, 3000) for s in range(1, 8)]
    pictures = [(100 + s, s, s if s % 2 else None, 0) for s in range(1, 8)]
    asks = []
    for ask in range(900):
        space = 1 if ask % 3 == 0 else rnd.choice([None, 2, 3, 4, 5, 99])
        picture = rnd.choice([None, None, 100 + (space or 2), 101, 999])
        asks.append((ask, space if rnd.random() < 0.9 and space else 3, rnd.random() < 0.1, space, picture, rnd.randint(0, 60)))
    frames = (
        spark.createDataFrame(asks, "ask int, asker long, asker_admin boolean, spaceId long, pictureId long, picSize long").repartition(5),
        spark.createDataFrame(spaces, "id long, userId long, totalCount long, totalSize long, maxCount long, maxSize long"),
        spark.createDataFrame(pictures, "id long, userId long, spaceId long, isDelete int"),
    )
    got = {r["ask"]: r["code"] for r in admission.upload_admissions(*frames, "ask").collect()}
    have = {s[0]: list(s[1:]) for s in spaces}
    old = {p[0]: p for p in pictures}
    want = {}
    for ask, asker, admin, space, picture, size in asks:
        owner, count, used, most, largest = have.get(space, [None] * 5)
        o = old.get(picture)
        code = 0
        if space is not None and owner is None:
            code = 40400
        elif space is not None and owner != asker:
            code = 40101
        elif space is not None and (count >= most or used >= largest):
            code = 50001
        elif picture is not None and o is None:
            code = 40400
        elif picture is not None and o[1] != asker and not admin:
            code = 40101
        elif picture is not None and space is not None and o[2] != space:
            code = 40000
        to = space if space is not None else o[2] if o else None
        if code == 0 and to is not None:
            have[to][1] += 1
            have[to][2] += size
        want[ask] = code
    assert got == want and {0, 50001, 40101, 40400, 40000} <= set(want.values())


def test_first_claims(spark):
    rows = spark.createDataFrame([(5, "a", 0), (2, "a", 0), (1, "a", 9), (7, None, 0), (6, None, 0), (3, "b", 0)], "i int, k string, code int")
    got = {r["i"]: r["code"] for r in admission.first_claims(rows, ["k"], "i", F.col("code") == 0, 1).collect()}
    assert got == {5: 1, 2: 0, 1: 9, 7: 1, 6: 0, 3: 0}


def test_deep_pages(spark):
    rows = [(i, (i * 37) % 50) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(9)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for current in (1, 2, 37, 100, 101, 500):
        page = Page(current, 10, "v")
        assert [tuple(r) for r in paging.deep(df, page).collect()] == order[10 * (current - 1) : 10 * current]
    assert paging.deep(df.where("false"), Page(1, 10)).count() == 0


def test_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert [tuple(r) for r in paging.one(df.where("id = 1")).collect()] == [(1, "a")]
    assert paging.one(df.where("id = 3")).collect() == []
    with pytest.raises(Exception, match="found more"):
        paging.one(df).collect()
    (page,) = {r["total"] for r in paging.page_and_total(df, Page(1, 1)).collect()}
    assert page == 2
