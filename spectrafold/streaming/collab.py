"""The edit lock of a picture: as a fold over a batch, and as a stream with state.

Messages (seq, userId, pictureId, type, editAction) act in the order of seq:
ENTER_EDIT takes the lock if it is free; EXIT_EDIT by the holder frees it;
EDIT_ACTION passes if the sender holds the lock and the action is known;
everything else is ignored. DISCONNECT acts as EXIT_EDIT.

In a batch, messages are dealt by picture, sorted and walked in order; a task
remembers one holder. The lock is sequential, so one picture is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spectrafold.functions.scalars import label, said

# Fixed values.
TYPES = ("ENTER_EDIT", "EXIT_EDIT", "EDIT_ACTION")
ANSWERS = ("INFO", "ERROR")
ACTION_TEXT = {"ZOOM_IN": "放大操作", "ZOOM_OUT": "缩小操作", "ROTATE_LEFT": "左旋操作", "ROTATE_RIGHT": "右旋操作"}
NOTICE = {"JOIN": "%s加入编辑", "LEAVE": "%s离开编辑", "ENTER_EDIT": "%s开始编辑图片", "EXIT_EDIT": "%s退出编辑图片"}
ACTED = "%s执行%s"
ACTIONS = tuple(ACTION_TEXT)
ACCEPTED = "pictureId bigint, seq bigint, userId bigint, type string, editAction string"


def step(holder: int | None, user: int, kind: str, action: str | None) -> tuple[int | None, bool]:
    """The holder after a message, and whether the message is accepted."""
    if kind == "ENTER_EDIT" and holder is None:
        return user, True
    if kind in ("EXIT_EDIT", "DISCONNECT") and holder == user:
        return None, True
    return holder, kind == "EDIT_ACTION" and holder == user and action in ACTIONS


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages sorted by picture and seq, across batches: one holder is all that is remembered."""
    picture, holder = None, None
    for batch in batches:
        keep = []
        for p, user, kind, action in zip(batch["pictureId"], batch["userId"], batch["type"], batch["editAction"], strict=True):
            if p != picture:
                picture, holder = p, None
            holder, good = step(holder, user, kind, action)
            keep.append(good)
        yield batch[pd.Series(keep, index=batch.index, dtype=bool)]


def accepted(messages: DataFrame) -> DataFrame:
    """Accepted messages. A picture's messages pass one task in order, as its state demands, with constant memory."""
    rows = messages.select("pictureId", "seq", "userId", "type", "editAction").where(F.col("type").isin(*TYPES, "DISCONNECT") & F.col("pictureId").isNotNull())
    return rows.repartition("pictureId").sortWithinPartitions("pictureId", "seq").mapInPandas(_walk, ACCEPTED)


class EditLock(StatefulProcessor):
    """Keyed by picture; the state is the holder. Messages of a batch are sorted by seq; batches must come in that order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._holder = handle.getValueState("holder", "userId bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        holder = int(self._holder.get()[0]) if self._holder.exists() else None
        all_rows = pd.concat(list(rows)).sort_values("seq", kind="stable")
        keep = []
        for user, kind, action in zip(all_rows["userId"], all_rows["type"], all_rows["editAction"], strict=True):
            holder, good = step(holder, int(user), kind, action)
            keep.append(good)
        if holder is None:
            self._holder.clear()
        else:
            self._holder.update((holder,))
        yield all_rows[keep][["pictureId", "seq", "userId", "type", "editAction"]]

    def close(self) -> None:
        pass


def accepted_stream(messages: DataFrame) -> DataFrame:
    """The streaming form; needs the RocksDB state store provider."""
    return messages.groupBy("pictureId").transformWithStateInPandas(EditLock(), ACCEPTED, "append", "None")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the streams started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_stream(messages: DataFrame, path: str) -> DataFrame:
    """Run the stream to the end of what its source has now; accepted messages go below path, which all executors share."""
    spark = messages.sparkSession
    with rocksdb(spark):
        rows = messages.select("pictureId", "seq", "userId", "type", "editAction").where(F.col("type").isin(*TYPES, "DISCONNECT") & F.col("pictureId").isNotNull())
        writer = accepted_stream(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ACCEPTED).parquet(f"{path}/out")


def changes(log: DataFrame, session: str = "userId") -> DataFrame:
    """log (moment, pictureId, userId, type JOIN or LEAVE) with `change`: 1 where a session opens, -1 where an open one ends, else 0. `session` tells the sessions of a picture apart."""
    own = Window.partitionBy("pictureId", session).orderBy("moment")
    before = F.coalesce(F.lag("type").over(own), F.lit("LEAVE"))
    return log.select("moment", "pictureId", *dict.fromkeys(["userId", session]), "type", F.when(F.col("type") == before, 0).when(F.col("type") == "JOIN", 1).otherwise(-1).alias("change"))


def sessions(log: DataFrame) -> DataFrame:
    """moment, pictureId and the number of open sessions after each JOIN or LEAVE: joining twice or leaving unknown changes nothing."""
    order = Window.partitionBy("pictureId").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    return changes(log).select("pictureId", "moment", F.sum("change").over(order).cast("bigint").alias("open"))


def _sent(done: DataFrame) -> DataFrame:
    return done.select("pictureId", "userId", "seq", "type", (F.col("seq") * 4 + 1).alias("moment"))


def fan_out(done: DataFrame, log: DataFrame) -> DataFrame:
    """Receivers of each accepted message: the sessions open at that moment, without the sender's own for an EDIT_ACTION. A row for each message and receiver, as they are sent."""
    own = Window.partitionBy("pictureId", "userId").orderBy("moment")
    moved = changes(log).where("change <> 0").withColumn("until", F.lead("moment").over(own)).where("change = 1")
    opened = moved.select(F.col("pictureId").alias("_p"), F.col("userId").alias("receiver"), F.col("moment").alias("_since"), "until")
    met = _sent(done).join(opened, (F.col("pictureId") == F.col("_p")) & (F.col("_since") < F.col("moment")) & (F.col("until").isNull() | (F.col("moment") < F.col("until"))))
    return met.where((F.col("type") != "EDIT_ACTION") | (F.col("receiver") != F.col("userId"))).select("pictureId", "seq", "userId", "type", "receiver")


def receivers(done: DataFrame, log: DataFrame) -> DataFrame:
    """pictureId, seq, type and the number of receivers of each accepted message, from running sums: no pair of message and receiver is made."""
    moves = changes(log).select("pictureId", "userId", "moment", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("kind"), "change")
    every = moves.unionByName(_sent(done).select("pictureId", "userId", "moment", "seq", F.col("type").alias("kind"), F.lit(0).alias("change")))
    room = Window.partitionBy("pictureId").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("pictureId", "userId").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    both = every.withColumn("open", F.sum("change").over(room)).withColumn("present", F.sum("change").over(own))
    number = F.col("open") - F.when(F.col("kind") == "EDIT_ACTION", F.col("present")).otherwise(F.lit(0))
    return both.where(F.col("kind").isNotNull()).select("pictureId", "seq", F.col("kind").alias("type"), number.cast("bigint").alias("receivers"))


def notice(kind: Column, user_name: Column, action: Column) -> Column:
    """The text that goes out with a message."""
    out = F.lit(None).cast("string")
    for name, template in NOTICE.items():
        out = F.when(kind == name, said(template, user_name)).otherwise(out)
    return F.when(kind == "EDIT_ACTION", said(ACTED, user_name, label(action, ACTION_TEXT.items()))).otherwise(out)


def answer(kind: Column) -> Column:
    """Messages of the types that only the server sends are answered with ERROR."""
    return F.when(kind.isin(*ANSWERS), F.lit("ERROR"))


def fails(kind: Column) -> Column:
    """Whether a message ends in an exception: no type, or one that is not known."""
    return ~F.coalesce(kind.isin(*TYPES, *ANSWERS), F.lit(False))
