"""Logon sessions as state: batches, late rows, expiry, logoff."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from hostgrain.streaming import events as X

T0 = dt.datetime(2024, 1, 1)
DDL = "u string, id long, ts timestamp, kd string"


def test_sessions_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([], DDL).write.parquet(src)
    seen = []

    def deliver(*rows):
        """One more drop and batch; what is new in the result, by (key, event, minute, session, note)."""
        spark.createDataFrame([(k, i, T0 + dt.timedelta(minutes=m), kd) for k, i, m, kd in rows], DDL).coalesce(1).write.mode("append").parquet(src)
        with X.timer_store(spark):
            stream = X.event_stream(spark, src, DDL, 1)
            X.ingest(X.track_sessions(stream, "u", "id", "ts", F.col("kd"), idle="2 hours"), out, out + "-checkpoint")
        now = sorted(((r.key, r.event_id, int((r.ts - T0).total_seconds() // 60), r.session_id, r.note) for r in spark.read.parquet(out).collect()), key=repr)
        new = [r for r in now if r not in seen]
        seen[:] = now
        return new

    assert deliver(("a", 1, 0, "logon"), ("a", 2, 10, "x"), ("b", 3, 5, "x"), (None, 9, 1, "x")) == [("a", 1, 0, 1, None), ("a", 2, 10, 1, None), ("b", 3, 5, None, None)]
    # The next batch goes on with the session; the timer fires once the watermark has passed.
    assert ("a", 4, 20, 1, None) in deliver(("a", 4, 20, "x"), ("b", 5, 300, "logon"))
    deliver(("b", 6, 310, "x"), ("a", 7, 15, "x"))
    assert ("a", None, 140, 1, "expired") in seen and ("b", 6, 310, 5, None) in seen
    assert ("a", 7, 15, None, "late") in seen and ("a", 7, 15, 1, None) not in seen
    deliver(("b", 8, 320, "logoff"), ("b", 10, 321, "x"))
    assert ("b", 8, 320, 5, None) in seen and ("b", 10, 321, None, None) in seen
    deliver(("c", 11, 330, "logon"), ("c", 12, 330, "x"), ("c", 13, 500, "x"))  # idle in between, within one batch
    assert {r for r in seen if r[0] == "c"} == {("c", 11, 330, 11, None), ("c", 12, 330, 11, None), ("c", None, 450, 11, "expired"), ("c", 13, 500, None, None)}
    done, late = X.split_late(spark.read.parquet(out))
    assert [tuple(r) for r in late.select("key", "event_id", "kind").collect()] == [("a", 7, "x")] and done.count() == len(seen) - 1


class _Calls:
    """A state and its timers in place of Spark's, with the calls that would each go to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_calls_of_state_do_not_grow_with_rows():
    """Rows come one by one, without a table a key; four calls a key at most, whatever the number of its rows."""
    store = _Calls()
    tracker = X.SessionTracker(idle_us=60_000_000)
    tracker.init(store)

    def give(*rows):
        store.calls.clear()
        return [(r.event_id, r.us, r.session_id, r.note) for r in tracker.handleInputRows(("a",), (Row(event_id=i, us=us, kind=k) for i, us, k in rows), store)]

    assert give((1, 5, "x")) == [(1, 5, None, None)] and store.calls == ["get"] and not store.timers
    assert give((3, 2_000, "x"), (2, 1_000, X.LOGON), *((i, 3_000, "x") for i in range(10, 60)))[:2] == [(2, 1_000, 2, None), (3, 2_000, 2, None)]
    assert store.calls == ["get", "update", "register"] and store.timers == {60_003}
    assert give((70, 9_000, "x")) == [(70, 9_000, 2, None)] and store.calls == ["get", "update", "delete", "register"] and store.timers == {60_009}
    assert give((71, 9_000, "x")) == [(71, 9_000, 2, None)] and store.calls == ["get"]
    assert give((72, 60_009_000, None)) == [(None, 60_009_000, 2, "expired"), (72, 60_009_000, None, None)] and store.value is None and not store.timers
