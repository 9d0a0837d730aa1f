"""Fleet analytics over artefact tables: timeline, execution evidence, rarity, persistence, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nested as N
from .scan import running


def timeline(parts: dict[str, tuple[DataFrame, dict[str, str | Column], Column, Column]], host: str = "host") -> DataFrame:
    """(host, ts, artefact, what, subject, sid) of every instant of every table. parts: artefact to (table, what to
    instant column, subject, sid); null instants are left out. One scan a table: its instants are unpivoted in place."""
    out = None
    for artefact, (df, instants, subject, sid) in parts.items():
        each = F.explode(F.array(*(F.struct(F.lit(w).alias("what"), (F.col(c) if isinstance(c, str) else c).cast("timestamp").alias("ts")) for w, c in instants.items())))
        one = df.select(F.col(host).alias("host"), subject.cast("string").alias("subject"), sid.cast("string").alias("sid"), each.alias("x"))
        one = one.filter(F.col("x.ts").isNotNull()).select("host", "x.ts", F.lit(artefact).alias("artefact"), "x.what", "subject", "sid")
        out = one if out is None else out.unionByName(one)
    return out


#: The tables that show that a program ran or was there.
EVIDENCE = ["prefetch", "bam", "userassist", "shimcache", "amcache", "muicache"]


def evidence_of_tables(prefetch: DataFrame, bam: DataFrame, userassist: DataFrame, shimcache: DataFrame, amcache: DataFrame, muicache: DataFrame, volumes: DataFrame) -> DataFrame:
    """host, program, source, ts: what execution_evidence() takes, from the six artefact tables. A program is its path in lower case, with
    a drive letter in place of a device name (volumes: host, device, letter). Prefetch gives a row for each run; the cache of names has no instant, and
    its names end with a property that is cut off."""
    from . import lookups as L

    none = F.lit(None).cast("timestamp")
    runs = prefetch.select("host", F.col("full_path").alias("path"), F.explode_outer("runs").alias("ts"))
    plain = lambda df, path, ts: df.select("host", F.col(path).alias("path"), ts.alias("ts"))
    name = F.regexp_replace("name", r"\.(FriendlyAppName|ApplicationCompany)$", "")
    parts = [
        runs, plain(bam, "name", F.col("exec_ts")), plain(userassist, "name", F.col("last_ts")), plain(shimcache, "path", F.col("last_mod_ts")), plain(amcache, "long_path", F.col("link_ts")),
        muicache.select("host", name.alias("path"), none.alias("ts")),
    ]
    each = N.tagged_union(dict(zip(EVIDENCE, parts, strict=True))).filter("path IS NOT NULL AND path <> ''")
    return L.drive_letters(each, "path", volumes, "program").select("host", F.lower("program").alias("program"), "source", "ts")


def execution_evidence(evidence: DataFrame, sources: list[str]) -> DataFrame:
    """One row per (host, program): how often each source saw it, and the first and last instant over all. evidence:
    host, program, source, ts. Sums are partial before the shuffle."""
    counts = [F.count(F.when(F.col("source") == s, 1)).alias(f"n_{s}") for s in sources]
    return evidence.groupBy("host", "program").agg(*counts, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def rarity(df: DataFrame, keys: list[str], host: str = "host", hosts_exactly: bool = True) -> DataFrame:
    """Hosts per key; approximate counting for keys that most of a large fleet has."""
    n = F.count_distinct(host) if hosts_exactly else F.approx_count_distinct(host, 0.01)
    return df.groupBy(*keys).agg(n.alias("hosts"), F.count("*").alias("rows"))


def rarity_sketches(df: DataFrame, parts: list[str], keys: list[str], host: str = "host", lg_k: int = 12) -> DataFrame:
    """For each part (such as a day) and key a sketch of its hosts, ``hosts_sketch``, and its rows: a table to be stored, from which
    rarity over any parts follows without the rows."""
    return df.groupBy(*parts, *keys).agg(F.hll_sketch_agg(F.col(host).cast("string"), lg_k).alias("hosts_sketch"), F.count("*").alias("rows"))


def rarity_of_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with about how many hosts have them, over all parts that are given."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("hosts_sketch")).alias("hosts"), F.sum("rows").alias("rows"))


def rare_keys(df: DataFrame, sketches: DataFrame, keys: list[str], most: int, host: str = "host", slack: float = 0.1) -> DataFrame:
    """Keys that at most so many hosts have, with their exact number. Rows are counted only of keys that sketches put at most
    slack above that; a sketch of few hosts is exact, and slack is six standard errors of a large one."""
    maybe = rarity_of_sketches(sketches, keys).filter(F.col("hosts") <= most * (1 + slack) + 1).select(*keys)
    return rarity(df.join(maybe, keys, "left_semi"), keys, host).filter(F.col("hosts") <= most)


def rarest(df: DataFrame, keys: list[str], k: int, host: str = "host") -> DataFrame:
    """The k rarest keys: a top-k report, ties by key."""
    return rarity(df, keys, host).orderBy("hosts", *keys).limit(k)


def persistence_inventory(run: DataFrame, services: DataFrame, actions: DataFrame) -> DataFrame:
    """host, kind, name and command of all that starts by itself, from the tables of run keys, services and task actions."""
    text = lambda *cs: F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in cs))
    return N.tagged_union({
        "run": run.select("host", F.concat_ws("\\", F.nullif(F.col("sid"), F.lit("")), "key", "name").alias("name"), F.col("value").alias("command")),
        "service": services.select("host", "name", F.col("binary").alias("command")),
        "task": actions.select("host", F.col("task_path").alias("name"), text("command", "arguments").alias("command")),
    }, "kind")


def stays(inventory: DataFrame, host: str, collected: str, keys: list[str]) -> DataFrame:
    """Islands: for each key of a host the runs of successive collections of that host that have it, with the first and last
    collection, how many they are, and whether the run reaches the host's latest. A gap is a collection of the host without the key. Rows that
    a collection repeats count once. Windows are over a host's collections, and over those that have one key."""
    has = inventory.select(host, collected, *keys).distinct()
    numbers = Window.partitionBy(host).orderBy(collected)
    taken = inventory.select(host, collected).distinct().withColumn("_n", F.row_number().over(numbers))
    taken = taken.withColumn("_latest", F.max("_n").over(Window.partitionBy(host)))
    d = has.join(taken, [host, collected])
    d = d.withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy(host, *keys).orderBy("_n")))
    out = d.groupBy(host, *keys, "_island").agg(F.min(collected).alias("first"), F.max(collected).alias("last"), F.count("*").alias("collections"), F.max(F.col("_n") == F.col("_latest")).alias("present"))
    return out.drop("_island")


def multiset_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side has more often than the other: columns, change (added or removed) and copies, how many more. One
    aggregation over both sides; rows that are equal cancel out wherever they lie, so a hot row is summed before it is shuffled."""
    signed = before.select(*columns, F.lit(-1).alias("_sign")).unionByName(after.select(*columns, F.lit(1).alias("_sign")))
    left = signed.groupBy(*columns).agg(F.sum("_sign").alias("_sum")).filter("_sum <> 0")
    return left.select(*columns, F.when(F.col("_sum") > 0, "added").otherwise("removed").alias("change"), F.abs("_sum").alias("copies"))


def inventory_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that were added, removed or changed between two inventories. Equal rows cancel first; of a key with several rows, what is left
    on both sides is paired in the order of values."""
    left = multiset_diff(before.select(*keys, value), after.select(*keys, value), [*keys, value])
    left = left.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    left = left.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "change").orderBy(value, "_copy")))
    was, now = F.col("change") == "removed", F.col("change") == "added"
    both = left.groupBy(*keys, "_rank").agg(F.max(F.when(was, F.col(value))).alias("before"), F.max(F.when(now, F.col(value))).alias("after"), F.max(was).alias("_in_a"), F.max(now).alias("_in_b"))
    return both.withColumn("change", F.when(~F.col("_in_a"), "added").when(~F.col("_in_b"), "removed").otherwise("changed")).drop("_rank", "_in_a", "_in_b")


def token_join(left: DataFrame, text: str, right: DataFrame, token: str, separators: str = r"[^A-Za-z0-9-]+") -> DataFrame:
    """Rows of left whose text has the right side's token as a whole token: an equi-join on split tokens, not a
    comparison of all pairs."""
    t = left.withColumn("_token", F.explode(F.array_distinct(F.filter(F.split(F.lower(text), separators), lambda x: x != ""))))
    return t.join(right.withColumn("_token", F.lower(token)), "_token").drop("_token")


def as_of(events: DataFrame, states: DataFrame, keys: list[str], ts: str, columns: list[str], order: str) -> DataFrame:
    """Each event with the columns of the latest state of its key at or before its instant (at one instant, that with the
    greatest order); nulls before the first. One shuffle and sort of both sides together; a key of any share of the rows lies in many tasks."""
    held = F.struct(*(F.col(c) for c in columns))
    s = states.select(*keys, F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.col(order).alias("_order"), held.alias("_state"), F.lit(None).cast(events.schema.simpleString()).alias("_event"))
    e = events.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(s.schema["_order"].dataType).alias("_order"), F.lit(None).cast(s.schema["_state"].dataType).alias("_state"), F.struct(*events.columns).alias("_event"))
    both = running(s.unionByName(e), keys, [F.col(c) for c in ("_ts", "_side", "_order")], lasts={"_last": F.col("_state")}).filter("_side = 1")
    return both.select("_event.*", *(F.col(f"_last.{c}").alias(c) for c in columns))


def media_trail(usb: DataFrame, mounts: DataFrame, links: DataFrame) -> DataFrame:
    """Which removable device a shortcut's target was on: links with ``serial`` and ``way``. usb: host, serial. mounts: host, drive, device
    (its text holds the serial as a token), ts, the collection that found it so. links: host, drive, vol_serial, ts and others.

    A letter belongs to a device from one collection to the next that finds another there, or none (null device): each link
    gets the device that its letter had at its instant (way ``letter``). A link of another letter or host whose volume serial such a link
    has is on the same device, if that is one device only (way ``volume``). Other links have nulls."""
    named = token_join(mounts.filter("device IS NOT NULL"), "device", usb.select(F.col("host").alias("_host"), "serial").distinct(), "serial")
    named = named.filter(F.col("_host") == F.col("host")).groupBy("host", "drive", "ts").agg(F.min("serial").alias("serial"))
    found = mounts.select("host", "drive", "ts").distinct().join(named, ["host", "drive", "ts"], "left")
    at = as_of(links, found, ["host", "drive"], "ts", ["serial"], "serial")
    volumes = at.filter("serial IS NOT NULL AND vol_serial IS NOT NULL").groupBy("vol_serial").agg(F.min("serial").alias("_a"), F.max("serial").alias("_b")).filter("_a = _b")
    out = at.join(volumes.select("vol_serial", F.col("_a").alias("_serial")), "vol_serial", "left")
    way = F.when(F.col("serial").isNotNull(), "letter").when(F.col("_serial").isNotNull(), "volume")
    return out.withColumn("way", way).withColumn("serial", F.coalesce("serial", "_serial")).select(*links.columns, "serial", "way")


def first_last(df: DataFrame, keys: list[str], ts: str, value: str, order: str) -> DataFrame:
    """First and last instant of each key and the value seen at either."""
    at = F.struct(ts, order)
    return df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))


def top_programs(df: DataFrame, user: list[str], program: str, k: int) -> DataFrame:
    """The k programs that each user ran most often, ties by name: a top-k report. Counts come before ranks."""
    counted = df.groupBy(*user, program).agg(F.count("*").alias("runs"))
    return N.mru_rank(counted, user, [F.desc("runs"), F.col(program)]).filter(F.col("rank") < k)


def process_ancestry(processes: DataFrame, keys: list[str], pid: str = "pid", ppid: str = "ppid", name: str = "name") -> DataFrame:
    """Processes with the path from their oldest known ancestor, its depth (null in a cycle of parents and below it), and
    whether their own parent is unknown."""
    paths = N.tree_paths(processes, keys, pid, ppid, name)
    known = processes.select(*keys, F.col(pid).alias(ppid)).distinct()
    orphans = processes.join(known, [*keys, ppid], "left_anti").select(*keys, pid).withColumn("orphan", F.lit(True))
    return paths.join(orphans, [*keys, pid], "left").withColumn("orphan", F.coalesce("orphan", F.lit(False)))


def listed(df: DataFrame, hashes: DataFrame, md5: str = "md5", deny: bool = True) -> DataFrame:
    """Rows whose hash is on a list (deny), or not on it (an allow list's rest)."""
    return df.join(hashes.select(F.upper("md5").alias("_md5")).distinct(), F.upper(df[md5]) == F.col("_md5"), "left_semi" if deny else "left_anti")
