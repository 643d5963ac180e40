"""Keyed state that lives in the state store: versioned sessions, job leases with timers, append-only histories, sessions by gap.

All of them resume from ``checkpoint`` and write into ``sink``; both are folders that driver and
executors share. A micro-batch's rows go to a folder named by the batch's number, so a batch that is
run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandmill.operators.versions import decide

MOST_ATTEMPTS = 4
#: Typed state needs RocksDB.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: State that expires by the clock would ask for empty batches without end.
CLOCKED = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark, values: dict[str, str]):
    """Queries started inside have ``values``; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, outputs: dict[str, Column] | None = None, clocked: bool = False) -> dict[str, DataFrame]:
    """Run to the end of the input; each output holds the rows for which its condition is true, all of them by default."""
    outputs = outputs or {"rows": F.lit(True)}

    def keep(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, condition in outputs.items():
            batch.where(condition).write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")
        batch.unpersist()

    with settings(stream.sparkSession, STATE | (CLOCKED if clocked else {})):
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return {name: stream.sparkSession.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).option("basePath", f"{sink}/{name}").parquet(f"{sink}/{name}/batch=*") for name in outputs}


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """A key's rows of one micro-batch by ``columns``; the source's limits (files or bytes a trigger) bound them."""
    return sorted((r for chunk in rows for r in chunk[columns].itertuples(index=False, name=None)), key=lambda r: tuple((x is None or x is pd.NaT, x) for x in r[:2]))


class Versions(StatefulProcessor):
    """(version, closed) of a session; commands (ts, command, base, closes, and the session before the first batch) get an outcome each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "version long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        commands, found = _in_order(rows, ["ts", "command", "base", "closes", "first_version", "first_closed"]), []
        version, closed = (None if pd.isna(commands[0][4]) else int(commands[0][4])), commands[0][5] is True
        known = version is not None
        if known and self.session.exists():
            version, closed = self.session.get()
        before = (version, closed)
        for _, command, base, closes, _, _ in commands:
            outcome = "unknown"
            if known:
                outcome, version, closed = decide(version, closed, None if pd.isna(base) else int(base), closes is True)
            found.append((key[0], command, outcome, version))
        if (version, closed) != before:
            self.session.update((version, closed))
        yield pd.DataFrame(found, columns=["key", "command", "outcome", "version"]).astype({"version": "Int64"})

    def close(self) -> None:
        pass


def version_stream(commands: DataFrame, sessions: DataFrame, sink: str, checkpoint: str) -> dict[str, DataFrame]:
    """``accepted`` and ``rejected`` rows (key, command, outcome, version) of a stream (key, ts, command, base, closes).

    ``sessions`` (key, version, closed) is the state before the first batch; it is not read again after a restart.
    It is stored beside the checkpoint, where commands meet it, so only sessions that have commands enter the state store.
    """
    out = T.StructType([commands.schema["key"], commands.schema["command"], T.StructField("outcome", T.StringType()), T.StructField("version", T.LongType())])
    begun = F.max(F.struct(F.col("version").cast("long").alias("first_version"), F.coalesce("closed", F.lit(False)).alias("first_closed")))
    first = _kept(sessions.groupBy("key").agg(begun.alias("_s")).select("key", "_s.*"), f"{checkpoint.rstrip('/')}-sessions")
    decided = commands.join(first, "key", "left").groupBy("key").transformWithStateInPandas(Versions(), out, "append", "None")
    accepted = F.col("outcome") == "accepted"
    return run_to_end(decided, sink, checkpoint, outputs={"accepted": accepted, "rejected": ~accepted})


def _kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it was when it was first stored under ``path``; whatever fails before it is whole leaves nothing there."""
    store, place = fs.FileSystem.from_uri(path)
    if store.get_file_info(place).type == fs.FileType.NotFound:
        staged = f"{path}.{uuid.uuid4().hex}"
        df.write.parquet(staged)
        store.move(fs.FileSystem.from_uri(staged)[1], place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Leases(StatefulProcessor):
    """Jobs that workers claim, with leases and retry times as event-time timers.

    Per job the state is its attempts and until when it is hidden. A claim hides a pending job for
    the lease; a failed attempt hides it until its retry time, and the last one ends it; a delivery ends
    it. State of ended jobs is dropped. When the time comes, whether by a timer or before a later
    row, the job is visible again.
    """

    def __init__(self, lease_ms: int, backoff_ms: int):
        self.lease_ms, self.backoff_ms = lease_ms, backoff_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempts int, hidden_until long")

    def _hide(self, until: int | None, before: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        if until is not None:
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        exists, found = self.job.exists(), []
        attempts, hidden = self.job.get() if exists else (0, None)
        timer = hidden
        for at, event, kind in _in_order(rows, ["ms", "event", "kind"]):
            if exists and hidden is not None and hidden <= at:
                found.append((key[0], hidden, None, "visible"))
                hidden = None
            if not exists:
                outcome = "created" if kind == "create" else "unknown"
                exists, attempts, hidden = kind == "create", 0, None
            elif kind == "claim":
                outcome = "claimed" if hidden is None else "hidden"
                hidden = at + self.lease_ms if hidden is None else hidden
            elif kind == "fail":
                attempts += 1
                outcome, exists = ("retry", True) if attempts < MOST_ATTEMPTS else ("failed", False)
                hidden = at + attempts * self.backoff_ms
            elif kind == "deliver":
                outcome, exists = "delivered", False
            else:
                outcome = "ignored"
            found.append((key[0], at, event, outcome))
        hidden = hidden if exists else None
        if hidden != timer:
            self._hide(hidden, timer)
        if exists:
            self.job.update((attempts, hidden))
        elif self.job.exists():
            self.job.clear()
        yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        attempts, hidden = self.job.get() if self.job.exists() else (0, None)
        if hidden == at:
            self.job.update((attempts, None))
            yield self._frame([(key[0], at, None, "visible")])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "ms", "event", "outcome"]).astype({"event": "Int64"})

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, sink: str, checkpoint: str, lease: int, backoff: int, delay: str = "1 hour") -> DataFrame:
    """(key, ms, event, outcome) of a stream (key, ts, event, kind); ``lease`` and ``backoff`` in seconds.

    Kinds are create, claim, fail and deliver. A job whose time has not come when the stream ends stays hidden.
    """
    stamped = events.withWatermark("ts", delay).select("key", "ts", F.unix_millis("ts").alias("ms"), "event", "kind")
    out = T.StructType([stamped.schema["key"], T.StructField("ms", T.LongType()), T.StructField("event", T.LongType()), T.StructField("outcome", T.StringType())])
    told = stamped.groupBy("key").transformWithStateInPandas(Leases(lease * 1000, backoff * 1000), out, "append", "EventTime")
    return run_to_end(told, sink, checkpoint)["rows"].drop("batch")


class Histories(StatefulProcessor):
    """Append-only lists with a length; entries expire on their own, and a list is never read or written whole."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "entry string", ttlDurationMs=self.days * 86_400_000)
        self.length = handle.getValueState("length", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.length.get()[0] if self.length.exists() else 0
        for chunk in rows:
            self.entries.appendList([(e,) for e in chunk["entry"]])
            yield pd.DataFrame({"key": [key[0]] * len(chunk), "place": range(n + 1, n + 1 + len(chunk)), "entry": chunk["entry"]})
            n += len(chunk)
        self.length.update((n,))

    def close(self) -> None:
        pass


def history_stream(events: DataFrame, sink: str, checkpoint: str, days: int = 30) -> DataFrame:
    """(key, place, entry): every entry of a stream (key, entry) with its place in its key's history, in the order of arrival."""
    out = T.StructType([events.schema["key"], T.StructField("place", T.LongType()), T.StructField("entry", T.StringType())])
    told = events.groupBy("key").transformWithStateInPandas(Histories(days), out, "append", "ProcessingTime")
    return run_to_end(told, sink, checkpoint, clocked=True)["rows"].drop("batch")


def session_stream(events: DataFrame, sink: str, checkpoint: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """(key, start, end, n, open) of sessions that end when nothing came for ``gap``.

    Sessions that the watermark has passed are written once and leave the state; the open ones are
    what the state store still holds when the input ends.
    """
    spark = events.sparkSession
    grouped = events.withWatermark("ts", delay).groupBy("key", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))
    closed = run_to_end(grouped.select("key", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n"), sink, checkpoint)["rows"].drop("batch")
    with settings(spark, STATE):
        state = spark.read.format("statestore").option("path", checkpoint).load()
    value = F.col("value")
    held = state.select(value["key"].alias("key"), value["session_window"]["start"].alias("start"), value["session_window"]["end"].alias("end"), value["count"].alias("n"))
    return closed.withColumn("open", F.lit(False)).unionByName(held.withColumn("open", F.lit(True)))
