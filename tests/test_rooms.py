"""Rooms, admission and usage as streams: against plain walks, with events out of order over many files, and batches repeated."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest

from spectrafold.operators import permissions
from spectrafold.streaming import batches, collab, rooms

START = datetime(2024, 3, 1)


def plain(events):
    """HAPPENED and SENT by one walk over all events in order."""
    out, sent, state = [], [], {}
    for _, moment, picture, user, session, kind, action in sorted(events, key=lambda e: e[:2]):
        if kind not in rooms.KINDS or picture is None or user is None:
            continue
        lock = state.setdefault(picture, {"holder": None, "open": set()})
        holder, inside = lock["holder"], lock["open"]
        freed = False
        if kind == "JOIN":
            inside.add(session)
        elif kind == "ENTER_EDIT" and holder is None:
            lock["holder"] = user
        elif kind in ("EXIT_EDIT", "DISCONNECT") and holder == user:
            lock["holder"], freed = None, True
        elif kind != "DISCONNECT" and not (kind == "EDIT_ACTION" and holder == user and action in collab.ACTIONS):
            continue
        if kind == "DISCONNECT":
            inside.discard(session)
        to = inside - ({session} if kind == "EDIT_ACTION" else set())
        out.append((picture, moment, user, session, kind, action, freed, len(inside), len(to)))
        sent += [(picture, moment, session, kind, r) for r in to]
    return sorted(out), sorted(sent)


@pytest.fixture(scope="module")
def events():
    """Two pictures, three users with two sessions each; a third of the events are JOINs and DISCONNECTs. One picture gets most."""
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        user = rnd.randrange(1, 4)
        kind = rnd.choice(["JOIN", "JOIN", "DISCONNECT", "ENTER_EDIT", "EXIT_EDIT", "EDIT_ACTION", "EDIT_ACTION", "BOGUS"])
        action = rnd.choice([*collab.ACTIONS, "NOPE", None])
        rows.append((START + timedelta(minutes=i), i, rnd.choice([1, 1, 1, 2]), user, user * 10 + rnd.randrange(2), kind, action))
    rows += [(None, 900, 1, 1, 10, "JOIN", None), (START, 901, None, 1, 10, "JOIN", None), (START, 902, 1, None, 10, "JOIN", None)]
    return rows


def files(spark, events, folder, order):
    """The events in 20 slices of time, in files that a stream reads in `order`, one in each micro-batch."""
    dated, rest = [e for e in events if e[0]], [e for e in events if not e[0]]
    for place, piece in enumerate(order):
        low, high = START + timedelta(minutes=20 * piece), START + timedelta(minutes=20 * (piece + 1))
        part = [e for e in dated if low <= e[0] < high] + (rest if place == 0 else [])
        random.Random(piece).shuffle(part)
        to = folder / f"part-{place}"
        spark.createDataFrame(part, rooms.EVENT).coalesce(1).write.parquet(str(to))
        (file,) = to.glob("*.parquet")
        os.utime(file, (1_700_000_000 + place, 1_700_000_000 + place))
    return spark.readStream.schema(rooms.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part-*")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_events_of_shuffled_files_act_in_order(spark, events, tmp_path):
    order = list(range(20))
    random.Random(1).shuffle(order)
    want, _ = plain([e for e in events if e[0]])
    got = rows(rooms.run(files(spark, events, tmp_path / "in", order), f"file://{tmp_path}/run", "8 hours"))
    assert got == want
    assert any(r[6] and r[4] == "DISCONNECT" for r in want)


def test_events_act_while_the_stream_runs(spark, events, tmp_path):
    """Neighbouring files change places, the delay covers two of them: timers let events act between micro-batches."""
    order = [i ^ 1 for i in range(20)]
    _, want = plain([e for e in events if e[0]])
    assert rows(rooms.run(files(spark, events, tmp_path / "in", order), f"file://{tmp_path}/run", "45 minutes", fan=True)) == want


def test_two_sessions_of_a_user_count_twice(spark):
    log = [(START, 1, 7, 5, 50, "JOIN", None), (START, 2, 7, 5, 51, "JOIN", None), (START, 3, 7, 5, 50, "ENTER_EDIT", None), (START, 4, 7, 5, 51, "EDIT_ACTION", "ZOOM_IN"), (START, 5, 7, 5, 51, "DISCONNECT", None), (START, 6, 7, 5, 50, "EDIT_ACTION", "ZOOM_IN")]
    got = rows(rooms.batch(spark.createDataFrame(log, rooms.EVENT)))
    # Leaving with one session frees the user's lock, so the last action is ignored.
    assert [(r[1], r[4], r[6], r[7], r[8]) for r in got] == [(1, "JOIN", False, 1, 1), (2, "JOIN", False, 2, 2), (3, "ENTER_EDIT", False, 2, 2), (4, "EDIT_ACTION", False, 2, 1), (5, "DISCONNECT", True, 1, 1)]
    assert [tuple(r) for r in got] == plain(log)[0]


def test_batch_form(spark, events):
    sound = [e for e in events if e[0] and e[2] and e[3]]
    assert rows(rooms.batch(spark.createDataFrame(sound, rooms.EVENT).repartition(5))) == plain(sound)[0]
    assert rooms.batch(spark.createDataFrame([], rooms.EVENT)).count() == 0


class Kept:
    """A state of any kind in memory, which counts the values that go to it."""

    def __init__(self):
        self.value, self.list, self.map, self.put_in = None, [], {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(self.list)

    def update(self, value):
        self.value = value
        self.put_in += 1

    def appendList(self, values):
        self.list += values
        self.put_in += len(values)

    def clear(self):
        self.value, self.list = None, []

    def iterator(self):
        return iter(self.map.items())

    def updateValue(self, key, value):
        self.map[key] = value
        self.put_in += 1


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Kept())

    def getListState(self, name, schema):
        return self.states.setdefault(name, Kept())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Kept())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def getCurrentWatermarkInMs(self):
        return 4_000_000_000_000


def test_many_events_are_few_values(spark):
    """What a task exchanges with the state store grows neither with each event nor each session, what it hands back not with each pair."""
    log = [(START + timedelta(seconds=i), i, 1, i % 500, i % 500, "JOIN" if i < 1500 else "DISCONNECT", None) for i in range(2000)]
    work, handle = rooms.Rooms(True), Handle()
    work.init(handle)
    frame = pd.DataFrame(log, columns=["at", "moment", "pictureId", "userId", "sessionId", "type", "editAction"])
    assert list(work.handleInputRows((1,), iter([frame]), None)) == []
    out = pd.concat(work.handleExpiredTimer((1,), handle, None))
    assert sum(s.put_in for s in handle.states.values()) < 10
    _, sent = plain(log)
    assert len(sent) > 700_000 and len(out) < 100
    stays = spark.createDataFrame([tuple(r) for r in out.itertuples(index=False)], rooms.STAYS)
    assert {tuple(r) for r in rooms.pairs(rooms._together(stays)).collect()} == set(sent)


def test_more_sessions_and_events_than_go_together(spark, tmp_path):
    """Stays begin and end in any row, at its first event too; sessions join twice, leave unknown and come again. The streaming form gives the same pairs."""
    rnd, n = random.Random(5), rooms.TOGETHER
    kinds = ["JOIN"] * 4 + ["DISCONNECT", "ENTER_EDIT", "EXIT_EDIT", "EDIT_ACTION"]
    log = [(START + timedelta(seconds=i), i, 1, u := rnd.randrange(n * 2), u, "JOIN" if i < n * 2 else rnd.choice(kinds), "ZOOM_IN") for i in range(n * 6)]
    log += [(e[0] + timedelta(seconds=n * 6), e[1] + n * 6, 1, 7, 7 + i % 2, k, "ZOOM_IN") for i, (e, k) in enumerate(zip(log[: n * 2], ["JOIN", "ENTER_EDIT", "EDIT_ACTION", "DISCONNECT"] * n, strict=False))]
    _, want = plain(log)
    assert max(Counter(r[1] for r in want).values()) > n and any(r[3] == "EDIT_ACTION" for r in want)
    later = (START + timedelta(days=9), n * 9, 2, 1, 1, "JOIN", None)
    spark.createDataFrame([*log, later], rooms.EVENT).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rooms.EVENT).parquet(str(tmp_path / "in"))
    assert rows(rooms.run(stream, f"file://{tmp_path}/run", "1 hour", fan=True)) == sorted([*want, (2, n * 9, 1, "JOIN", 1)])
    with collab.rocksdb(spark):
        writer = rooms.happened(stream, "1 hour", fan=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.schema(rooms.SENT).parquet(f"{tmp_path}/out")) == want


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], rooms.EVENT).write.parquet(str(tmp_path / "in"))
    assert rooms.run(spark.readStream.schema(rooms.EVENT).parquet(str(tmp_path / "in")), f"file://{tmp_path}/run", "1 hour").count() == 0


def test_handshakes(spark):
    users = spark.createDataFrame([(1, "user", 0), (2, "admin", 0), (3, "user", 1), (4, "user", 0)], "id long, userRole string, isDelete int")
    pictures = spark.createDataFrame([(10, None, 0), (11, 100, 0), (12, 101, 0), (13, 102, 0), (14, 100, 1)], "id long, spaceId long, isDelete int")
    spaces = spark.createDataFrame([(100, 1, 1, 0), (101, 0, 1, 0), (102, 1, 1, 1)], "id long, spaceType int, userId long, isDelete int")
    members = spark.createDataFrame([(100, 1, "editor"), (100, 4, "viewer")], "spaceId long, userId long, spaceRole string")
    asks = {(1, 10): "permission", (2, 10): None, (1, 11): None, (4, 11): "permission", (2, 11): "permission", (1, 12): "team", (1, 13): "space", (1, 14): "picture", (1, 99): "picture", (3, 11): "login", (None, 11): "login", (1, None): "picture_id", (None, None): "picture_id"}
    got = permissions.handshakes(spark.createDataFrame(list(asks), "userId long, pictureId long"), users, pictures, spaces, members)
    assert {(r["userId"], r["pictureId"]): r["refused"] for r in got.collect()} == asks


CHANGES = "spaceId long, picSize long, added boolean"


def changes(spark, folder, name, part):
    spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/in/{name}")
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def total(parts):
    out = {}
    for space, size, added in [r for p in parts for r in p]:
        if space is not None:
            sign = 1 if added else -1
            before = out.get(space, (0, 0))
            out[space] = (before[0] + sign * (size or 0), before[1] + sign)
    return sorted((s, *v) for s, v in out.items())


def test_usage_survives_repeated_batches_and_folds(spark, tmp_path):
    rnd = random.Random(2)
    parts = [[(rnd.choice([None, 1, 1, 2, 3]), rnd.choice([None, 5, 70]), rnd.random() < 0.7) for _ in range(50)] for _ in range(4)]
    path = f"file://{tmp_path}/usage"
    for n in (0, 1):
        stream = changes(spark, tmp_path, n, parts[n])
    assert rows(batches.keep_usage(stream, path)) == total(parts[:2])
    first = spark.createDataFrame(parts[0], CHANGES)
    # What Spark does after a failure: the same batch with the same number again.
    batches.write_batch(batches.picture_deltas(first), path, 0)
    assert rows(batches.usage(spark, path)) == total(parts[:2])
    assert batches.fold(spark, path) == batches.fold(spark, path) == 1
    assert rows(batches.usage(spark, path)) == total(parts[:2])
    for n in (2, 3):
        stream = changes(spark, tmp_path, n, parts[n])
    assert rows(batches.keep_usage(stream, path)) == total(parts)
    assert batches.fold(spark, path) == 3
    assert rows(batches.usage(spark, path)) == total(parts)


def test_usage_without_changes(spark, tmp_path):
    assert rows(batches.keep_usage(changes(spark, tmp_path, 0, []), f"file://{tmp_path}/usage")) == []
