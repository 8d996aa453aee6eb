"""The edit lock against a plain fold, batch and stream alike."""

import random

import pytest

from spectrafold.streaming import collab

SCHEMA = "seq bigint, userId bigint, pictureId bigint, type string, editAction string"


def plain(messages):
    holder, out = {}, []
    for seq, user, picture, kind, action in sorted(messages):
        now = holder.get(picture)
        if kind == "ENTER_EDIT" and now is None:
            holder[picture] = user
        elif kind in ("EXIT_EDIT", "DISCONNECT") and now is not None and now == user:
            holder[picture] = None
        elif not (kind == "EDIT_ACTION" and now is not None and now == user and action in collab.ACTIONS):
            continue
        out.append((picture, seq, user, kind, action))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def messages():
    rnd = random.Random(3)
    return [
        (i, rnd.randrange(3), rnd.randrange(4), rnd.choice(["ENTER_EDIT", "EXIT_EDIT", "EDIT_ACTION", "EDIT_ACTION", "DISCONNECT", "BOGUS"]), rnd.choice([*collab.ACTIONS, "NOPE", None]))
        for i in range(400)
    ]


def test_batch(spark, messages):
    got = sorted((tuple(r) for r in collab.accepted(spark.createDataFrame(messages, SCHEMA)).collect()), key=repr)
    assert got == plain(messages)


def test_stream(spark, messages, tmp_path):
    spark.createDataFrame(messages, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = sorted((tuple(r) for r in collab.run_stream(stream, f"file://{tmp_path}/run").collect()), key=repr)
    assert got == plain(messages)


def test_no_messages(spark):
    assert collab.accepted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sessions_and_receivers_against_a_set(spark):
    rnd = random.Random(5)
    log = [(k * 4 + rnd.choice([0, 2]), rnd.randrange(2), rnd.randrange(4), rnd.choice(["JOIN", "LEAVE"])) for k in range(0, 200, 2)]
    done = [(rnd.randrange(2), k, rnd.randrange(4), rnd.choice(collab.TYPES), None) for k in range(1, 200, 2)]
    room, opened, sent, count = {0: set(), 1: set()}, [], [], []
    for at, picture, user, kind in sorted([*log, *[(s * 4 + 1, p, u, t) for p, s, u, t, _ in done]]):
        if kind in ("JOIN", "LEAVE"):
            (room[picture].add if kind == "JOIN" else room[picture].discard)(user)
            opened.append((picture, at, len(room[picture])))
        else:
            to = room[picture] - ({user} if kind == "EDIT_ACTION" else set())
            sent += [(picture, at // 4, r) for r in to]
            count.append((picture, at // 4, kind, len(to)))
    log = spark.createDataFrame(log, "moment bigint, pictureId bigint, userId bigint, type string")
    done = spark.createDataFrame(done, collab.ACCEPTED)
    assert sorted(tuple(r) for r in collab.sessions(log).collect()) == sorted(opened)
    assert sorted((r["pictureId"], r["seq"], r["receiver"]) for r in collab.fan_out(done, log).collect()) == sorted(sent)
    assert sorted(tuple(r) for r in collab.receivers(done, log).collect()) == sorted(count)
