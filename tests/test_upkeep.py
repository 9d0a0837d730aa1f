"""Upkeep by batches, replays and cut-off compactions; sketches, islands and differences of multisets."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hostgrain.operators import analytics as D
from hostgrain.streaming import events as X
from hostgrain.streaming import upkeep as U

DDL = "user string, ts long, what string, id long"


def batches(n=5, size=60):
    r = random.Random(3)
    return [[(f"u{r.randrange(7)}", r.randrange(1000), r.choice("abc"), 1000 * k + i) for i in range(size)] for k in range(n)]


def first_last(rows):
    by = defaultdict(list)
    for u, ts, what, i in rows:
        by[u].append((ts, i, what))
    return sorted((u, min(x)[0], max(x)[0], min(x)[2], max(x)[2], len(x)) for u, x in by.items())


def shown(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    path, kept, all_rows = str(tmp_path), U.first_last_kept(["user"], "ts", "what", "id"), batches()
    assert U.read_kept(spark, path, kept) is None
    U.compact(spark, path, kept)
    for k, rows in enumerate(all_rows):
        df = spark.createDataFrame(rows, DDL)
        U.take_in(df, k, path, kept)
        U.take_in(df, k, path, kept)  # as after a failure between the sink and its checkpoint
        assert shown(U.read_kept(spark, path, kept)) == first_last([r for b in all_rows[: k + 1] for r in b])
        if k in (1, 3):
            U.compact(spark, path, kept)
            U.compact(spark, path, kept)
            U.take_in(df, k, path, kept)
            U.take_in(spark.createDataFrame(all_rows[0], DDL), 0, path, kept)
            assert U.reached(spark, path) == (k // 2, k)
    # A version without its row in the ledger doesn't count.
    spark.createDataFrame([("u1", 1)], "user string, x int").write.parquet(f"{path}/{U.VERSIONS}/version=2")
    assert shown(U.read_kept(spark, path, kept)) == first_last([r for b in all_rows for r in b])
    U.compact(spark, path, kept)
    assert U.reached(spark, path) == (2, 4) and shown(U.read_kept(spark, path, kept)) == first_last([r for b in all_rows for r in b])


def test_streams_in_batches_equal_one_pass(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "kept")
    rows = [r for b in batches() for r in b]
    spark.createDataFrame(rows, DDL).repartition(6).write.parquet(src)
    kept = U.rarity_kept(["what"], "user")
    U.keep_up(X.event_stream(spark, src, DDL, 1), path, path + "-checkpoint", kept)
    assert len(U._folders(spark, path, U.PARTIALS)) > 3
    users = defaultdict(set)
    for u, _, what, _ in rows:
        users[what].add(u)
    assert shown(U.read_kept(spark, path, kept)) == sorted((w, len(u), sum(r[2] == w for r in rows)) for w, u in users.items())


def test_sketches_of_parts_give_the_rare_keys(spark):
    rows = [(f"h{i}", "common", i % 5) for i in range(3000)] + [(f"h{i}", f"k{k}", i % 5) for k in range(20) for i in range(k)] + [(None, "none", 0)]
    df = spark.createDataFrame(rows * 2, "host string, path string, day int")
    parts = D.rarity_sketches(df, ["day"], ["path"])
    one, many = D.rarity_sketches(df, [], ["path"]), {r.path: r for r in D.rarity_of_sketches(parts, ["path"]).collect()}
    assert {r.path: (r.hosts, r.rows) for r in D.rarity_of_sketches(one, ["path"]).collect()} == {k: (r.hosts, r.rows) for k, r in many.items()}
    assert abs(many["common"].hosts - 3000) < 150
    got = {r.path: (r.hosts, r.rows) for r in D.rare_keys(df, parts, ["path"], 7).collect()}
    assert got == {f"k{k}": (k, 2 * k) for k in range(1, 8)} | {"none": (0, 2)}


def test_stays_are_islands(spark):
    taken = {"a": [1, 2, 3, 5, 8], "b": [4]}
    rows = [("a", t, "x") for t in (1, 2, 5, 5)] + [("a", t, "y") for t in (3, 8)] + [("a", 2, None), ("b", 4, "x")]
    rows += [(h, t, "always") for h, ts in taken.items() for t in ts]
    got = {tuple(r) for r in D.stays(spark.createDataFrame(rows, "host string, t int, name string").dropna(subset=["name"]), "host", "t", ["name"]).collect()}
    assert got == {("a", "x", 1, 2, 2, False), ("a", "x", 5, 5, 1, False), ("a", "y", 3, 3, 1, False), ("a", "y", 8, 8, 1, True), ("b", "x", 4, 4, 1, True), ("a", "always", 1, 8, 5, True), ("b", "always", 4, 4, 1, True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_of_multisets(spark, seed):
    r = random.Random(seed)
    side = lambda: [(r.randrange(5), r.choice(["p", "q", None])) for _ in range(40)]
    a, b = side(), side()
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    want = {(*k, "added", n) for k, n in (Counter(b) - Counter(a)).items()} | {(*k, "removed", n) for k, n in (Counter(a) - Counter(b)).items()}
    assert {tuple(x) for x in D.multiset_diff(df(a), df(b), ["k", "v"]).collect()} == want
    assert D.inventory_diff(df(a), df(a), ["k"], "v").count() == 0  # equal inventories, keys on several rows
    got = D.inventory_diff(df(a), df(b), ["k"], "v").collect()
    for k in range(5):
        gone, new = (sum(n for x, n in (Counter(s) - Counter(t)).items() if x[0] == k) for s, t in ((a, b), (b, a)))
        assert Counter(x.change for x in got if x.k == k) == +Counter(changed=min(gone, new), removed=max(0, gone - new), added=max(0, new - gone))


def test_inventory_of_what_starts(spark):
    run = spark.createDataFrame([("h", "", "Run", "n", "c"), ("h", "S-1", "RunOnce", "m", None)], "host string, sid string, key string, name string, value string")
    services = spark.createDataFrame([("h", "svc", "b.exe")], "host string, name string, binary string")
    actions = spark.createDataFrame([("h", "\\t", "x.exe", "-a"), ("h", "\\u", "y.exe", "")], "host string, task_path string, command string, arguments string")
    got = {(r.kind, r.name, r.command) for r in D.persistence_inventory(run, services, actions).select("kind", "name", F.col("command")).collect()}
    assert got == {("run", "Run\\n", "c"), ("run", "S-1\\RunOnce\\m", None), ("service", "svc", "b.exe"), ("task", "\\t", "x.exe -a"), ("task", "\\u", "y.exe")}
