"""Rooms of pictures as one stream with state: who is connected, who holds the edit lock, who is sent what.

Events (at, moment, pictureId, userId, sessionId, type, editAction) act in the order of (at, moment), however they are dealt
over files and micro-batches: an event is held until the watermark has passed its time, then a timer lets it act. JOIN opens a
session, DISCONNECT frees the lock if the user holds it and then closes the session; a user may have several sessions.
The other types are those of `collab.step`. JOIN, DISCONNECT and accepted messages go to the sessions that are open then,
an EDIT_ACTION to all but the one it comes from.

Events that come later than the watermark allows are left out by Spark, as are those without time, picture, user or session.
The state of a picture is its holder, its open sessions and the events of one watermark delay, many events to a value in Arrow's
stream format, since each value of a state goes to and from Python by itself; one picture is one task's work, as its lock
demands. Two equal (at, moment) of a picture act in the order of session and type.

Receivers leave that task as stays: for some events of a picture in their order, each session and the events from `since` to
before `until` that it is open at. Pairs of event and receiver come from them in Spark, where they are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spectrafold.sources.folders import shared_folder
from spectrafold.streaming.collab import TYPES, accepted, changes, rocksdb, step

EVENT = "at timestamp, moment bigint, pictureId bigint, userId bigint, sessionId bigint, type string, editAction string"
HELD = pa.schema([("us", pa.int64()), ("moment", pa.int64()), ("sessionId", pa.int64()), ("type", pa.string()), ("userId", pa.int64()), ("editAction", pa.string())])
OPEN = "sessionId array<bigint>, userId array<bigint>"
HAPPENED = "pictureId bigint, moment bigint, userId bigint, sessionId bigint, type string, editAction string, released boolean, open bigint, receivers bigint"
SENT = "pictureId bigint, moment bigint, sessionId bigint, type string, receiver bigint"
STAYS = "pictureId bigint, moment array<bigint>, sessionId array<bigint>, type array<string>, receiver array<bigint>, since array<int>, until array<int>"
KINDS = (*TYPES, "JOIN", "DISCONNECT")
#: Rows of a frame that a task hands back, and events of a row of HELD.
FRAME = 10_000
#: Events, and stays, of a row of STAYS: Spark keeps all pairs of such a row in memory at once.
TOGETHER = 256
#: The picture of the row that ends a stream. Ids are positive.
_END = -1
#: Its time; pandas knows none much later.
_LAST = datetime(2262, 1, 1)


class Room:
    """The state of a picture in memory, moved by one event after the other."""

    def __init__(self, holder: int | None, sessions: dict[int, int]):
        self.holder, self.sessions = holder, sessions

    def act(self, session: int, kind: str, user: int, action: str | None) -> tuple[bool, bool]:
        """Whether the event goes out, and whether it frees the lock."""
        if kind == "JOIN":
            self.sessions[session] = user
            return True, False
        self.holder, good = step(self.holder, user, kind, action)
        if kind == "DISCONNECT":
            self.sessions.pop(session, None)
        return good or kind == "DISCONNECT", good and kind in ("EXIT_EDIT", "DISCONNECT")

    def sent_to(self, session: int, kind: str) -> int:
        return len(self.sessions) - (kind == "EDIT_ACTION" and session in self.sessions)


def _frames(rows: Iterable[tuple], columns: list[str], most: int = FRAME) -> Iterator[pd.DataFrame]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield pd.DataFrame(part, columns=columns)
            part = []
    if part:
        yield pd.DataFrame(part, columns=columns)


def _packed(events: pa.Table) -> list[tuple]:
    """Values of the state for HELD events."""
    out = []
    for part in events.combine_chunks().to_batches(max_chunksize=FRAME):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD) as writer:
            writer.write_batch(part)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _values(events: pa.Table) -> Iterator[tuple]:
    """moment, sessionId, type, userId, editAction of HELD events."""
    return zip(*(events[c].to_numpy().tolist() for c in HELD.names[1:]), strict=True)


class Rooms(StatefulProcessor):
    """Keyed by picture. fan: receivers of the events (STAYS), else a row for each event (HAPPENED)."""

    def __init__(self, fan: bool):
        self._fan = fan
        self._columns = [c.split()[0] for c in (STAYS if fan else HAPPENED).split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._holder = handle.getValueState("holder", "userId bigint")
        self._sessions = handle.getValueState("sessions", OPEN)
        self._held = handle.getListState("held", "events binary")
        self._next = handle.getValueState("next", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] != _END:
            least = None
            for frame in rows:
                us = frame["at"].astype("datetime64[us]").astype("int64")
                self._held.appendList(_packed(pa.Table.from_pandas(frame.assign(us=us)[HELD.names], HELD, preserve_index=False)))
                low = int(us.min())
                least = low if least is None else min(least, low)
            if least is not None:
                self._wake(least)
        return iter(())

    def _wake(self, us: int) -> None:
        """One timer a picture: at the least time of what is held."""
        ms = us // 1000 + 1
        if self._next.exists():
            before = int(self._next.get()[0])
            if before <= ms:
                return
            self._handle.deleteTimer(before)
        self._handle.registerTimer(ms)
        self._next.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = pa.concat_tables([HELD.empty_table(), *(pa.ipc.open_stream(bytes(h[0])).read_all() for h in self._held.get())])
        is_due = pc.less_equal(held["us"], now)
        due, later = held.filter(is_due).sort_by([(c, "ascending") for c in HELD.names[:4]]), held.filter(pc.invert(is_due))
        self._next.clear()
        if later.num_rows:
            self._held.put(_packed(later))
            self._wake(pc.min(later["us"]).as_py())
        else:
            self._held.clear()
        before = dict(zip(*self._sessions.get(), strict=True)) if self._sessions.exists() else {}
        room = Room(int(self._holder.get()[0]) if self._holder.exists() else None, dict(before))
        if self._fan:
            yield from _frames(self._stays(int(key[0]), room, due), self._columns, FRAME // 100)
        else:
            yield from _frames(self._out(int(key[0]), room, due), self._columns)
        self._keep(room, before)

    def _out(self, picture: int, room: Room, due: pa.Table) -> Iterator[tuple]:
        for moment, session, kind, user, action in _values(due):
            out, freed = room.act(session, kind, user, action)
            if out:
                yield picture, moment, user, session, kind, action, freed, len(room.sessions), room.sent_to(session, kind)

    def _stays(self, picture: int, room: Room, due: pa.Table) -> Iterator[tuple]:
        """Rows of STAYS. A session that opens is open at its JOIN, one that closes isn't at its DISCONNECT."""
        events, over, since = [], [], dict.fromkeys(room.sessions, 0)
        for moment, session, kind, user, action in _values(due):
            out, _ = room.act(session, kind, user, action)
            if not out:
                continue
            if kind == "JOIN":
                since.setdefault(session, len(events))
            elif kind == "DISCONNECT" and since.get(session, len(events)) < len(events):
                over.append((session, since[session], len(events)))
            if kind == "DISCONNECT":
                since.pop(session, None)
            events.append((moment, session, kind))
            if len(events) == TOGETHER:
                yield from self._rows(picture, events, over, since)
                events, over, since = [], [], dict.fromkeys(room.sessions, 0)
        yield from self._rows(picture, events, over, since)

    def _rows(self, picture: int, events: list[tuple], over: list[tuple], since: dict[int, int]) -> Iterator[tuple]:
        stays = over + [(s, at, len(events)) for s, at in since.items()]
        if events:
            columns = tuple(map(list, zip(*events, strict=True)))
            for i in range(0, len(stays), TOGETHER):
                yield picture, *columns, *map(list, zip(*stays[i : i + TOGETHER], strict=True))

    def _keep(self, room: Room, before: dict[int, int]) -> None:
        if not room.sessions:
            self._sessions.clear()
        elif room.sessions != before:
            self._sessions.update((list(room.sessions), list(room.sessions.values())))
        if room.holder is None:
            self._holder.clear()
        else:
            self._holder.update((room.holder,))

    def close(self) -> None:
        pass


def _moved(events: DataFrame, delay: str, fan: bool) -> DataFrame:
    rows = events.select(*[c.split()[0] for c in EVENT.split(", ")]).withWatermark("at", delay)
    return rows.groupBy("pictureId").transformWithStateInPandas(Rooms(fan), STAYS if fan else HAPPENED, "append", "EventTime")


def happened(events: DataFrame, delay: str, fan: bool = False) -> DataFrame:
    """The streaming form; events that come up to `delay` after later ones still act in their order. Needs the RocksDB state store."""
    rows = _moved(events, delay, fan)
    return pairs(_together(rows)) if fan else rows


def _together(stays: DataFrame) -> DataFrame:
    return stays.select("pictureId", F.arrays_zip("moment", "sessionId", "type").alias("events"), F.arrays_zip("receiver", "since", "until").alias("stays"))


def pairs(together: DataFrame) -> DataFrame:
    """SENT: each stay with its events, but for an EDIT_ACTION of its own session."""
    each = together.select("pictureId", "events", F.inline("stays"))
    met = each.select("pictureId", "receiver", F.inline(F.slice("events", F.col("since") + 1, F.col("until") - F.col("since"))))
    return met.where("type <> 'EDIT_ACTION' or receiver <> sessionId").select("pictureId", "moment", "sessionId", "type", "receiver")


def run(events: DataFrame, path: str, delay: str, fan: bool = False) -> DataFrame:
    """Run the stream to the end of what its source has, then end it: a last row, later than all, lets every held event act.

    What comes out goes below path, which all executors share. A run that broke off is taken up by another one with the same path.
    """
    spark = events.sparkSession
    ending = f"{path}/ending"
    spark.createDataFrame([], EVENT).write.mode("append").parquet(ending)
    known = events.where(" and ".join(f"{c} is not null" for c in ("at", "moment", "pictureId", "userId", "sessionId")) + f" and type in {KINDS}")
    every = known.select(*[c.split()[0] for c in EVENT.split(", ")]).unionByName(spark.readStream.schema(EVENT).parquet(ending))

    def to_the_end() -> None:
        writer = _moved(every, delay, fan).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    with rocksdb(spark):
        to_the_end()
        last = (_LAST, 0, _END, 0, 0, "END", None)
        spark.createDataFrame([last], EVENT).coalesce(1).write.mode("append").parquet(ending)
        to_the_end()
    if not fan:
        return spark.read.schema(HAPPENED).parquet(f"{path}/out")
    # A row of few bytes has many pairs: they are dealt out by number.
    return pairs(_together(spark.read.schema(STAYS).parquet(f"{path}/out")).repartition(4 * spark.sparkContext.defaultParallelism))


def run_here(events: DataFrame, delay: str, fan: bool = False) -> DataFrame:
    """`run` in a new path of the shared folder."""
    return run(events, shared_folder(events.sparkSession, "rooms"), delay, fan)


def batch(events: DataFrame) -> DataFrame:
    """HAPPENED of a whole table of events: the lock by `collab.accepted`, sessions and receivers by running sums, no pair of message and receiver."""
    keys = ["pictureId", "userId", "moment"]
    done = accepted(events.withColumn("seq", F.col("moment"))).select(*keys[:2], F.col("seq").alias("moment"), F.col("type").alias("_done"))
    moves = changes(events.where("type in ('JOIN', 'DISCONNECT')").withColumn("type", F.when(F.col("type") == "JOIN", "JOIN").otherwise("LEAVE")), "sessionId")
    met = events.join(done, keys, "left").join(moves.select("pictureId", "moment", "sessionId", "change"), ["pictureId", "moment", "sessionId"], "left")
    met = met.withColumn("change", F.coalesce("change", F.lit(0)))
    room = Window.partitionBy("pictureId").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("pictureId", "sessionId").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("open", F.sum("change").over(room)).withColumn("_present", F.sum("change").over(own))
    out = met.where(F.col("_done").isNotNull() | F.col("type").isin("JOIN", "DISCONNECT"))
    freed = F.col("_done").isNotNull() & F.col("type").isin("EXIT_EDIT", "DISCONNECT")
    number = F.col("open") - F.when(F.col("type") == "EDIT_ACTION", F.col("_present")).otherwise(F.lit(0))
    return out.select("pictureId", "moment", "userId", "sessionId", "type", "editAction", freed.alias("released"), F.col("open").cast("bigint"), number.cast("bigint").alias("receivers"))
