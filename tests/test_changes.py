"""Changes of touched folders by file names, ids of new rows, and JDBC scans with pushed filters."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from spectrafold.operators import ids, mutate, touched
from spectrafold.sources import jdbc

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
FOLDERS = 16


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {f"{f.parent.name}/{f.name}" for f in path.glob(f"{touched.FOLDER}=*/*.parquet")}


@pytest.fixture
def laid_out(spark, tmp_path):
    base = spark.createDataFrame([(i, f"n{i}", "c" if i % 2 else None, 0) for i in range(600)] + [(None, "lost", None, 0)], "id long, name string, category string, isDelete int")
    touched.lay_out(base, f"file://{tmp_path}/t", "id", FOLDERS)
    return base, f"file://{tmp_path}/t", tmp_path / "t"


def test_laid_out(spark, laid_out):
    base, path, _ = laid_out
    assert rows(touched.read(spark, path, base.schema)) == rows(base)


def test_patch_leaves_other_folders(spark, laid_out):
    base, path, disk = laid_out
    before = files(disk)
    changes = spark.createDataFrame([(i, f"p{i}", None) for i in (3, 3, 4, 5)] + [(7000, "nobody", "x")], "id long, name string, category string")
    numbers = touched.patch(path, base.schema, changes, FOLDERS)
    after = files(disk)
    assert 0 < len(numbers) <= 4
    here = lambda names, inside: {f for f in names if (int(f.split("=")[1].split("/")[0]) in numbers) == inside}
    assert here(before, False) == here(after, False) and not here(before, True) & here(after, True)
    assert rows(touched.read(spark, path, base.schema)) == rows(mutate.patch(base, changes))


def test_upsert_and_deletions(spark, laid_out):
    base, path, _ = laid_out
    new = spark.createDataFrame([(3, "v2", None, 1), (9001, "added", "x", 0)], base.schema)
    gone = spark.createDataFrame([(5,), (6,), (8000,)], "id long")
    for _ in range(2):  # a repeated change changes nothing
        touched.upsert(path, base.schema, new, FOLDERS)
        touched.soft_delete(path, base.schema, gone, FOLDERS)
    touched.hard_delete(path, base.schema, spark.createDataFrame([(7,)], "id long"), FOLDERS)
    want = mutate.hard_delete(mutate.soft_delete(mutate.upsert(base, new), gone), spark.createDataFrame([(7,)], "id long"))
    assert rows(touched.read(spark, path, base.schema)) == rows(want)


def test_folder_that_loses_all_rows(spark, laid_out):
    base, path, disk = laid_out
    one = base.where(touched.folder_of("id", FOLDERS) == 3).where("id is not null").select("id")
    keys = spark.createDataFrame(one.collect(), one.schema)
    touched.hard_delete(path, base.schema, keys, FOLDERS)
    assert not any(f.startswith(f"{touched.FOLDER}=3/") for f in files(disk)) or base.where("id is null").where(touched.folder_of("id", FOLDERS) == 3).count()
    assert rows(touched.read(spark, path, base.schema)) == rows(base.join(keys, "id", "left_anti").select(*base.columns))
    touched.upsert(path, base.schema, base.join(keys, "id").select(*base.columns), FOLDERS)
    assert rows(touched.read(spark, path, base.schema)) == rows(base)


def test_no_changes(spark, laid_out):
    base, path, disk = laid_out
    before = files(disk)
    assert touched.patch(path, base.schema, spark.createDataFrame([], "id long, name string"), FOLDERS) == []
    assert files(disk) == before


def test_ids_are_unique_and_repeat(spark):
    now = 1_767_225_600_000
    asks = list(range(0, 3000, 3))
    random.Random(1).shuffle(asks)
    first = ids.assigned(spark.createDataFrame([(a,) for a in asks], "ask long").repartition(10), "ask", now).collect()
    again = ids.assigned(spark.createDataFrame([(a,) for a in reversed(asks)], "ask long").repartition(3), "ask", now).collect()
    assert {r["ask"]: r["id"] for r in first} == {r["ask"]: r["id"] for r in again} == {a: ids.first_id(now) + n for n, a in enumerate(sorted(asks))}
    assert ids.assigned(spark.createDataFrame([], "ask long"), "ask", now).count() == 0
    most = 1 << ids.BITS
    for number in (0, 1, most, most + 1):
        assert ids.first_id(ids.next_free(now, number)) >= ids.first_id(now) + number
    with pytest.raises(ValueError):
        ids.first_id(0)


@pytest.fixture
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    base = spark.createDataFrame([(i if i % 50 else None, f"n{i}", i % 7) for i in range(1, 1001)], "id long, name string, kind int")
    base.limit(0).write.jdbc(url, "pictures", properties={"driver": DERBY})
    jdbc.append(base, url, "pictures", DERBY)
    return url, base


def test_jdbc_scan_in_ranges_equals_the_table(spark, database):
    url, base = database
    scan = jdbc.scan(spark, url, "pictures", "id", DERBY, rows=130)
    assert scan.rdd.getNumPartitions() == 8
    assert rows(scan) == rows(base)
    sizes = [r["count"] for r in scan.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200
    assert rows(jdbc.scan(spark, url, "pictures", "id", DERBY)) == rows(base)


def test_jdbc_filters_and_columns_are_pushed(spark, database):
    url, base = database
    found = jdbc.scan(spark, url, "pictures", "id", DERBY, rows=130).where("kind = 3 and id > 500").select("name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(kind,3)" in plan and "GreaterThan(id,500)" in plan
    assert rows(found) == rows(base.where("kind = 3 and id > 500").select("name"))


def test_jdbc_empty_table_and_names(spark, database):
    url, base = database
    base.limit(0).write.jdbc(url, "nothing", properties={"driver": DERBY})
    assert jdbc.scan(spark, url, "nothing", "id", DERBY).count() == 0
    with pytest.raises(ValueError):
        jdbc.scan(spark, url, "pictures", 'i"d', DERBY)
