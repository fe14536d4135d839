"""Conversations as state: the last turns of each session, kept by a stream and published as a table that changes by commits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.session import stored
from ..sources.commits import Table
from ..sources.sinks import last_turns

TURN = "turn_no long, role string, content string"
#: A state store that transformWithState needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastTurns(StatefulProcessor):
    """List state of a session's last ``keep`` turns by number. A turn that comes again, as after a restart of its source, changes nothing; one that
    comes late takes its place. With ``idle_ms`` a session that is silent for so long is forgotten: its state expires, and a timer closes it."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", TURN, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {t[0]: tuple(t) for t in self.turns.get()} if self.turns.exists() else {}
        for frame in rows:
            for t in zip(frame["turn_no"].tolist(), frame["role"].tolist(), frame["content"].tolist(), strict=True):
                known.setdefault(int(t[0]), (int(t[0]), t[1], t[2]))
            known = {n: known[n] for n in sorted(known)[-self.keep :]}  # never more than these and a batch
        self.turns.put(list(known.values()))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key[0], known.values(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        yield self._row(key[0], [], True)

    @staticmethod
    def _row(session, turns, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [str(session)], "closed": [closed], "turns": [[{"turn_no": n, "role": r, "content": c} for n, r, c in turns]]})


OUT = "session_id string, closed boolean, turns array<struct<turn_no:long,role:string,content:string>>"


def session_states(turns: DataFrame, keep: int = 12, idle_ms: int | None = None) -> DataFrame:
    """OUT: of each session with new turns(session_id, turn_no, role, content), a stream, its last ``keep`` turns; closed once it has been idle too long."""
    mode = "ProcessingTime" if idle_ms is not None else "None"
    each = turns.where("session_id is not null and turn_no is not null").groupBy("session_id")
    return each.transformWithStateInPandas(LastTurns(keep, idle_ms), OUT, "Update", mode)


def keep_sessions(turns: DataFrame, table: Table, checkpoint: str, keep: int = 12, idle_ms: int | None = None) -> StreamingQuery:
    """Starts the store: what is new in the stream is taken into the sessions' state, and each micro-batch becomes a commit of the sessions it has
    touched (closed ones go). A batch that is replayed after a crash makes the same rows. Without ``idle_ms`` it ends when all input there is has been
    read; with it, it runs until it is stopped."""
    spark = turns.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        rows = stored(batch, "sessions")  # the state is read and written once
        live = rows.where("not closed").drop("closed")
        if table.snapshot().version < 0:
            table.create(live, 1)
            return
        if not live.isEmpty():
            table.upsert(live)
        if not rows.where("closed").isEmpty():
            table.delete(rows.where("closed"))

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        states = session_states(turns, keep, idle_ms)
        writer = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        # Timers of processing time make a query run on, so one that has them is the caller's to stop.
        return (writer.trigger(availableNow=True) if idle_ms is None else writer.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def turns_of(sessions: DataFrame) -> DataFrame:
    """The rows of a sessions table as turns: session_id, turn_no, role, content."""
    return sessions.select("session_id", F.inline("turns"))


def session_turns(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session's turns in order, by a search for its key alone."""
    return turns_of(Table(spark, path, "session_id").read().where(F.col("session_id") == session_id)).orderBy("turn_no")


def plain_last_turns(turns: DataFrame, keep: int = 12) -> DataFrame:
    """The same of a whole table, in one batch."""
    return last_turns(turns.dropDuplicates(["session_id", "turn_no"]), keep).select("session_id", "turn_no", "role", "content")
