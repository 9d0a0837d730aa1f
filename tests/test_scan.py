"""Running values with keys of moderate size and heavy ones, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from hostgrain.operators import analytics as D
from hostgrain.operators import lookups as L
from hostgrain.operators import nested as N
from hostgrain.operators import scan

DDL = "k string, t int, v int, flag boolean"


def rows(seed=1, n=900):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "hot", None, "a", "b", f"c{i % 40}"]), t, r.choice([None, r.randrange(50)]), r.random() < 0.03) for i, t in enumerate(r.sample(range(10 * n), n))]


def in_order(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[10**9, 50])
def limit(request, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_A_TASK", request.param)
    return request.param


def test_sums_and_lasts(spark, limit):
    data, want = rows(), set()
    for k, own in in_order(data).items():
        total, last = 0, None
        for r in own:
            total, last = total + (r[2] or 0), r[2] if r[2] is not None else last
            want.add((k, r[1], total, last))
    df = spark.createDataFrame(data, DDL).repartition(5)
    got = scan.running(df, ["k"], [F.col("t")], sums={"s": F.col("v")}, lasts={"l": F.col("v")})
    assert got.columns == ["k", "t", "v", "flag", "s", "l"] and {(r.k, r.t, r.s, r.l) for r in got.collect()} == want
    everything = {r.t: r.s for r in scan.running(df, [], [F.desc("t")], sums={"s": F.lit(1)}).collect()}
    assert everything == {t: i + 1 for i, t in enumerate(sorted((r[1] for r in data), reverse=True))}
    assert scan.running(df.limit(0), ["k"], [F.col("t")], sums={"s": F.col("v")}).count() == 0


def test_ranks_flags_and_states(spark, limit):
    data = rows(2)
    df, by = spark.createDataFrame(data, DDL).repartition(5), in_order(data)
    ranks = {(k, r[1]): i for k, own in by.items() for i, r in enumerate(reversed(own))}
    assert {(r.k, r.t): r["rank"] for r in N.mru_rank(df, ["k"], [F.desc("t")]).collect()} == ranks
    seen = {(k, r[1]): any(x[3] for x in own[:i]) for k, own in by.items() for i, r in enumerate(own)}
    assert {(r.k, r.t): r.seen for r in N.seen_before(df, ["k"], "t", F.col("flag"), "seen").collect()} == seen
    state = {(k, r[1]): next((x[1] for x in reversed(own[: i + 1]) if x[3]), None) for k, own in by.items() for i, r in enumerate(own)}
    states = df.filter("flag").select("k", "t", F.col("t").alias("began"))
    assert {(r.k, r.t): r.began for r in D.as_of(df.select("k", "t"), states, ["k"], "t", ["began"], "began").collect()} == state


def test_entries_up_to_a_gap(spark, limit):
    data = [r for r in rows(3) if r[0] is not None]
    df = spark.createDataFrame(data, DDL)
    there = df.filter("NOT flag").select("k", F.hex("t").alias("stream"))
    want = {(k, r[1]) for k, own in in_order(data).items() for i, r in enumerate(own) if not any(x[3] for x in own[: i + 1])}
    assert {(r.k, r.t) for r in L.entry_streams(df, there, ["k"], number="t", stop_at_gap="t").collect()} == want


def test_a_heavy_key_lies_in_many_stretches(spark, monkeypatch):
    """One key with half of the rows: what is summed at once is bounded by the partitions, not by the key."""
    monkeypatch.setattr(scan, "ROWS_A_TASK", 100)
    written, cut = [], scan.cut
    monkeypatch.setattr(scan, "cut", lambda df: (written.append(cut(df)), written[-1])[1])
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = scan.running(df, ["k"], [F.col("t")], sums={"n": F.lit(1)}).filter("k = 'hot'").orderBy("t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.n for r in got] == list(range(1, 2001))
    assert max(r["count"] for r in written[1].groupBy("_b").count().collect()) < 400
