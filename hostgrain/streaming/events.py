"""Structured Streaming over new drops: ingest, deduplication, windowed counts, logon sessions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, path: str, schema, files_a_batch: int | None = 100) -> DataFrame:
    """New files below a path, as they come; the schema is given, never inferred. Without a limit all files that are there
    make one batch: then none of their rows is late, in whatever order they were written."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else stream).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Takes in all that is there and ends; the next call goes on from the checkpoint, so nothing is read twice."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def deduplicate(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """One row per key while its first one is within the delay: state is dropped as the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, keys: list[str], size: str, ts: str = "ts", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per window and key; rows later than the delay are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    c = stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_counts(stream: DataFrame, keys: list[str], gap: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    c = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


#: The store of states that keeps timers.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_store(spark: SparkSession):
    """Queries started within keep states and timers in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


#: What an event means for its user's session.
LOGON, LOGOFF = "logon", "logoff"
#: Within the processor an instant is a number of microseconds.
_OUT = Row("key", "event_id", "us", "kind", "session_id", "session_us", "note")
_OUT_TYPES = "key string, event_id long, us long, kind string, session_id long, session_us long, note string"
SESSION_OUTPUT = "key string, event_id long, ts timestamp, kind string, session_id long, session_ts timestamp, note string"


class SessionTracker(StatefulProcessor):
    """The open session of a key as state. Rows: key, event_id, us, kind (logon, logoff or anything else).

    A logon opens a session, a new one in place of the last. Other events get the session that is open at their instant; a
    logoff closes it. A timer at event time ends a session that has had no event for idle_ms: that is a row with the note
    ``expired``, stamped with the instant at which it ran out. A row older than the watermark is not attributed, since the session that was open
    then may be gone: it comes out with the note ``late``, to be set apart by split_late(). Within a batch rows are taken by
instant, at one instant logons first, and then by event_id."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "session_id long, session_us long, last_us long")

    def _timer(self, held: tuple | None) -> int | None:
        """When a key's only timer fires: it hangs on the state, so that timers need not be listed."""
        return (held[2] + self.idle_us) // 1000 if held else None

    def _keep(self, before: tuple | None, held: tuple | None) -> None:
        if held == before:
            return
        if held:
            self.open.update(held)
        else:
            self.open.clear()
        old, new = self._timer(before), self._timer(held)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = 1000 * timerValues.getCurrentWatermarkInMs()
        before = held = self.open.get()
        for r in sorted(rows, key=lambda r: (r.us, r.kind != LOGON, r.event_id is None, r.event_id or 0)):
            if r.us < mark:
                yield _OUT(key[0], r.event_id, r.us, r.kind, None, None, "late")
                continue
            if held and r.us - held[2] >= self.idle_us:  # ran out before this row, though the timer is yet to fire
                yield self._ended(key, held)
                held = None
            if r.kind == LOGON:
                held = (r.event_id, r.us, r.us)
            elif held:
                held = (held[0], held[1], r.us)
            yield _OUT(key[0], r.event_id, r.us, r.kind, *(held[:2] if held else (None, None)), None)
            if r.kind == LOGOFF:
                held = None
        self._keep(before, held)

    def _ended(self, key, held: tuple) -> Row:
        return _OUT(key[0], None, held[2] + self.idle_us, "end", held[0], held[1], "expired")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if held := self.open.get():
            self.open.clear()
            yield self._ended(key, held)

    def close(self) -> None:
        pass


def track_sessions(stream: DataFrame, key: str, event_id: str, ts: str, kind: Column, idle: str = "8 hours", delay: str = "10 minutes") -> DataFrame:
    """Events with the logon session that was open at their instant, as they come: the columns of SESSION_OUTPUT. State is one row a key with an open
    session, whatever the number of its events, and ends by a timer. Rows without a key or an instant are left out. Late rows come out marked: the
    watermark is held by the processor itself, so that none is dropped unseen. Start it within timer_store()."""
    idle_us = pd.Timedelta(idle).value // 1000
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"), kind.alias("kind"))
    rows = rows.filter("key IS NOT NULL AND ts IS NOT NULL")
    # Spark drops rows whose marked instant is late. So the row itself has none, and one beside it moves the watermark, and goes no further.
    both = F.explode(F.array(F.lit(None).cast("timestamp"), F.col("ts"))).alias("mark")
    rows = rows.select("key", "event_id", F.unix_micros("ts").alias("us"), "kind", both).withWatermark("mark", delay).filter("mark IS NULL")
    out = rows.groupBy("key").transformWithState(SessionTracker(idle_us), _OUT_TYPES, "Append", "EventTime")
    instants = {"us": F.timestamp_micros("us").alias("ts"), "session_us": F.timestamp_micros("session_us").alias("session_ts")}
    return out.select(*(instants.get(c, F.col(c)) for c in out.columns))


def split_late(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What track_sessions() has written: events and ends of sessions, and the side table of late rows."""
    late = F.coalesce(F.col("note") == "late", F.lit(False))
    return rows.filter(~late), rows.filter(late).select("key", "event_id", "ts", "kind")
