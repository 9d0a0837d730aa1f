"""Fleet analytics, streams and SQL functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.sql import register_functions
from ..operators import analytics as D
from ..operators import nested as N
from ..operators.store import scratch
from ..streaming import events as X
from ..streaming import upkeep as U
from .registry import ntz, query, table, utc


@query("""SELECT 'h' AS host, o_orderdate AS ts, 'orders' AS artefact, 'ordered' AS what, o_orderkey::VARCHAR AS subject, o_custkey::VARCHAR AS sid FROM orders
UNION ALL SELECT 'h', l_shipdate, 'lineitem', 'shipped', l_orderkey::VARCHAR, NULL FROM lineitem
UNION ALL SELECT 'h', ts, 'events', w, event_type, user_id::VARCHAR FROM events, (VALUES ('seen'), ('logged')) AS v(w) WHERE w = 'seen' OR value > 50""")
def d1_timeline(spark, sf):
    h = lambda t: table(spark, sf, t).withColumn("host", F.lit("h"))
    null = F.lit(None).cast("string")
    out = D.timeline({
        "orders": (h("orders"), {"ordered": "o_orderdate"}, F.col("o_orderkey"), F.col("o_custkey")),
        "lineitem": (h("lineitem"), {"shipped": "l_shipdate"}, F.col("l_orderkey"), null),
        "events": (h("events"), {"seen": "ts", "logged": F.when(F.col("value") > 50, F.col("ts"))}, F.col("event_type"), F.col("user_id")),
    })
    return out.withColumn("ts", ntz(F.col("ts")))


@query("""SELECT user_id AS host, json_extract_string(props, '$.k') AS program, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view,
  min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL""")
def d2_execution_evidence(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("host"), F.get_json_object("props", "$.k").alias("program"), F.col("event_type").alias("source"), "ts")
    return D.execution_evidence(e, ["click", "view"])


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS hosts, count(*) AS rows FROM lineitem GROUP BY l_partkey")
def d3_rarity(spark, sf):
    return D.rarity(table(spark, sf, "lineitem"), ["l_partkey"], "l_suppkey")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS hosts, count(*) AS rows FROM lineitem GROUP BY l_partkey ORDER BY hosts, l_partkey LIMIT 25")
def d3_rarest(spark, sf):
    return D.rarest(table(spark, sf, "lineitem"), ["l_partkey"], 25, "l_suppkey")


@query("""WITH a AS (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), b AS (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.p AS before, b.p AS after, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.p IS DISTINCT FROM b.p""")
def d4_persistence_diff(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"))
    return D.inventory_diff(part(0), part(1), ["o_custkey"], "p")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS hosts, count(*) AS rows FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) <= 24")
def d3_rare_exact(spark, sf):
    """Exact counts of keys that sketches, kept by line number, say are rare."""
    d = table(spark, sf, "lineitem")
    return D.rare_keys(d, D.rarity_sketches(d, ["l_linenumber"], ["l_partkey"], "l_suppkey"), ["l_partkey"], 24, "l_suppkey")


@query("""WITH i AS (SELECT DISTINCT o_custkey % 40 AS host, date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS name FROM orders),
t AS (SELECT host, month, row_number() OVER (PARTITION BY host ORDER BY month) AS n FROM (SELECT DISTINCT host, month FROM i)),
r AS (SELECT host, name, month, n, n - row_number() OVER (PARTITION BY host, name ORDER BY n) AS island FROM i JOIN t USING (host, month))
SELECT host, name, min(month) AS first, max(month) AS last, count(*) AS collections, max(n) = (SELECT max(n) FROM t WHERE t.host = r.host) AS present FROM r GROUP BY host, name, island""")
def d4_stays(spark, sf):
    """Months as collections, priorities as what a host starts."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("host"), F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderpriority").alias("name"))
    return D.stays(o, "host", "month", ["name"])


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, sum(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, abs(n) AS copies FROM s WHERE n <> 0""")
def d4_multiset_diff(spark, sf):
    o = table(spark, sf, "orders")
    return D.multiset_diff(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"])


@query("""SELECT 'h' AS host, 'run' AS kind, 'S' || (user_id % 3) || '\\Run\\' || event_id AS name, props AS command FROM events WHERE event_type = 'click'
UNION ALL SELECT 'h', 'service', s_name, s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'h', 'task', o_orderkey::VARCHAR, o_orderpriority || ' ' || o_orderstatus FROM orders""".replace("\\\\", "\\"))
def d4_persistence_inventory(spark, sf):
    h = F.lit("h").alias("host")
    run = table(spark, sf, "events").filter("event_type = 'click'").select(h, F.concat(F.lit("S"), F.col("user_id") % 3).alias("sid"), F.lit("Run").alias("key"), F.col("event_id").cast("string").alias("name"), F.col("props").alias("value"))
    services = table(spark, sf, "supplier").select(h, F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("binary"))
    actions = table(spark, sf, "orders").select(h, F.col("o_orderkey").cast("string").alias("task_path"), F.col("o_orderpriority").alias("command"), F.col("o_orderstatus").alias("arguments"))
    return D.persistence_inventory(run, services, actions)


@query("""WITH t AS (SELECT DISTINCT page_id, unnest(regexp_split_to_array(lower(url), '[^A-Za-z0-9-]+')) AS token FROM pages),
s AS (SELECT DISTINCT regexp_extract(url, '://([^./]+)', 1) AS serial FROM pages WHERE page_id % 10 = 0)
SELECT page_id, serial FROM t JOIN s ON token = lower(serial) WHERE token <> ''""")
def d5_removable_media(spark, sf):
    p = table(spark, sf, "pages")
    serials = p.filter("page_id % 10 = 0").select(F.regexp_extract("url", "://([^./]+)", 1).alias("serial")).distinct()
    return D.token_join(p.select("page_id", "url"), "url", serials, "serial").select("page_id", "serial")


@query(r"""WITH e AS (SELECT 'h' || user_id % 20 AS host, '\Device\HarddiskVolume' || event_id % 4 || '\P' || event_id % 50 || '.EXE' AS path, event_id % 6 AS k, ts FROM events),
p AS (SELECT host, lower(CASE WHEN starts_with(path, '\Device\HarddiskVolume1\') THEN 'C:' || path[24:] WHEN starts_with(path, '\Device\HarddiskVolume2\') THEN 'D:' || path[24:] ELSE path END) AS program, k, CASE WHEN k < 5 THEN ts END AS ts FROM e)
SELECT host, program, count(*) FILTER (k = 0) AS n_prefetch, count(*) FILTER (k = 1) AS n_bam, count(*) FILTER (k = 2) AS n_userassist, count(*) FILTER (k = 3) AS n_shimcache, count(*) FILTER (k = 4) AS n_amcache, count(*) FILTER (k = 5) AS n_muicache,
  min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY ALL""")
def d2_evidence_tables(spark, sf):
    """Events dealt to the six tables, with device names that two volumes of each host translate."""
    path = F.concat(F.lit("\\Device\\HarddiskVolume"), F.col("event_id") % 4, F.lit("\\P"), F.col("event_id") % 50, F.lit(".EXE"))
    e = table(spark, sf, "events").select(F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"), path.alias("path"), (F.col("event_id") % 6).alias("k"), utc("ts").alias("ts"))
    of = lambda k, name, ts: e.filter(F.col("k") == k).select("host", F.col("path").alias(name), F.col("ts").alias(ts))
    prefetch = of(0, "full_path", "ts").withColumn("runs", F.array("ts"))
    mui = of(5, "name", "ts").withColumn("name", F.concat("name", F.lit(".FriendlyAppName")))
    volumes = e.select("host").distinct().crossJoin(spark.sql(r"SELECT * FROM VALUES (r'\Device\HarddiskVolume1', 'C:'), (r'\Device\HarddiskVolume2', 'D:') AS v(device, letter)"))
    out = D.execution_evidence(D.evidence_of_tables(prefetch, of(1, "name", "exec_ts"), of(2, "name", "last_ts"), of(3, "path", "last_mod_ts"), of(4, "long_path", "link_ts"), mui, volumes), D.EVIDENCE)
    return out.withColumns({c: ntz(F.col(c)) for c in ("first_ts", "last_ts")})


@query("""WITH m AS (SELECT user_id % 20 AS host, event_id % 3 AS drive, ts, max('s' || event_id % 30) FILTER (event_id % 30 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)) AS serial FROM events WHERE event_type = 'signup' GROUP BY ALL),
l AS (SELECT event_id, user_id % 20 AS host, event_id % 3 AS drive, event_id % 7 * 100 + event_id % 40 AS vol, ts FROM events WHERE event_type = 'click'),
a AS (SELECT l.event_id, l.vol, m.serial FROM l ASOF LEFT JOIN m ON l.host = m.host AND l.drive = m.drive AND l.ts >= m.ts),
v AS (SELECT vol, min(serial) AS serial FROM a GROUP BY vol HAVING count(DISTINCT serial) = 1)
SELECT event_id, coalesce(a.serial, v.serial) AS serial, CASE WHEN a.serial IS NOT NULL THEN 'letter' WHEN v.serial IS NOT NULL THEN 'volume' END AS way FROM a LEFT JOIN v ON a.vol = v.vol""")
def d5_media_trail(spark, sf):
    """Signups as mounts of devices at three letters, clicks as links; suppliers of even number as known devices."""
    e = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 20).alias("host"), (F.col("event_id") % 3).alias("drive"), "ts")
    device = F.concat(F.lit("_??_USBSTOR#Disk#S"), F.col("event_id") % 30, F.lit("#{53f56307}"))
    mounts = e.filter("event_type = 'signup'").select("host", "drive", device.alias("device"), "ts")
    usb = e.select("host").distinct().crossJoin(table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("serial")))
    links = e.filter("event_type = 'click'").select("event_id", "host", "drive", (F.col("event_id") % 7 * 100 + F.col("event_id") % 40).cast("string").alias("vol_serial"), "ts")
    return D.media_trail(usb, mounts, links).select("event_id", "serial", "way")


@query("""WITH s AS (SELECT user_id, ts, max(event_id) AS session_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, s.session_id FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def d6_as_of(spark, sf):
    e = table(spark, sf, "events")
    s = e.filter("event_type = 'signup'").withColumn("session_id", F.col("event_id"))
    return D.as_of(e.select("event_id", "user_id", "ts"), s, ["user_id"], "ts", ["session_id"], "session_id").select("event_id", "session_id")


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, struct_pack(t := ts, e := event_id)) AS first_value, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_value FROM events GROUP BY user_id""")
def d7_first_last(spark, sf):
    return D.first_last(table(spark, sf, "events"), ["user_id"], "ts", "event_type", "event_id")


@query("""SELECT user_id, event_type, runs, (r - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY runs DESC, event_type) AS r
FROM (SELECT user_id, event_type, count(*) AS runs FROM events GROUP BY ALL)) WHERE r <= 3""")
def d7_top_programs(spark, sf):
    return D.top_programs(table(spark, sf, "events"), ["user_id"], "event_type", 3)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS pid, p_partkey // 10 AS ppid, p_brand AS name FROM part WHERE p_partkey > 0),
t AS (SELECT pid, name AS path, 0 AS depth, NOT (ppid IN (SELECT pid FROM p)) AS orphan FROM p WHERE ppid NOT IN (SELECT pid FROM p)
  UNION ALL SELECT p.pid, t.path || '\\' || p.name, t.depth + 1, false FROM p JOIN t ON p.ppid = t.pid)
SELECT pid, path, depth, orphan FROM t""".replace("\\\\", "\\"))
def d8_process_ancestry(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey > 0").select(F.lit("h").alias("host"), F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 10).alias("ppid"), F.col("p_brand").alias("name"))
    return D.process_ancestry(p, ["host"]).select("pid", "path", "depth", "orphan")


@query("SELECT doc_id, upper(md5(text)) IN (SELECT upper(md5(text)) FROM documents WHERE doc_id % 3 = 0) AS denied FROM documents WHERE text IS NOT NULL")
def d9_hash_lists(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", S.md5_upper(F.col("text")).alias("md5"))
    deny = table(spark, sf, "documents").filter("doc_id % 3 = 0 AND text IS NOT NULL").select(F.md5("text").alias("md5"))
    return D.listed(d, deny).select("doc_id", F.lit(True).alias("denied")).unionByName(D.listed(d, deny, deny=False).select("doc_id", F.lit(False).alias("denied")))


def _stream(spark, sf):
    """The events as a stream of a drop folder's files. They are written in no order of time, so a replay takes them all
    in one batch, lest the watermark of one batch drops rows of the next."""
    drops = scratch(spark)
    table(spark, sf, "events").withColumn("ts", utc("ts")).write.parquet(drops)
    return X.event_stream(spark, drops, spark.read.parquet(drops).schema, files_a_batch=None)


def _run(spark, stream):
    out = scratch(spark)
    X.ingest(stream, out, out + "-checkpoint")
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id, ts, user_id, event_type FROM events")
def x1_ingest(spark, sf):
    d = _run(spark, _stream(spark, sf).select("event_id", "ts", "user_id", "event_type"))
    return d.withColumn("ts", ntz(F.col("ts")))


@query("SELECT event_id, event_type FROM events")
def x2_deduplicate(spark, sf):
    """Every event delivered twice."""
    s = _stream(spark, sf).select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return _run(spark, X.deduplicate(s, ["event_id"], delay="60 days")).select("event_id", "event_type")


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type FROM events)
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 1 HOUR <= {_CLOSED}""")
def x3_tumbling(spark, sf):
    """Windows that the watermark has closed."""
    d = _run(spark, X.tumbling_counts(_stream(spark, sf), ["event_type"], "1 hour"))
    return d.withColumns({"start": ntz(F.col("start")), "end": ntz(F.col("end"))})


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS start, event_type FROM events, range(3) AS r(i))
SELECT start, start + INTERVAL 3 HOUR AS "end", event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 3 HOUR <= {_CLOSED}""")
def x3_sliding(spark, sf):
    d = _run(spark, X.tumbling_counts(_stream(spark, sf), ["event_type"], "3 hours", slide="1 hour"))
    return d.withColumns({"start": ntz(F.col("start")), "end": ntz(F.col("end"))})


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u >= INTERVAL 6 HOUR OR lag(ts) OVER u IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""")
def x3_sessions(spark, sf):
    d = _run(spark, X.session_counts(_stream(spark, sf), ["user_id"], "6 hours"))
    return d.withColumns({"start": ntz(F.col("start")), "end": ntz(F.col("end"))})


def _waves(spark, sf, n=3):
    """The events as drops of n periods, one after the other; each user's rows of a period are in one file, so that batches of
    any number of files take them in order."""
    drops, e = scratch(spark), table(spark, sf, "events").withColumn("ts", utc("ts"))
    bounds = e.select(F.unix_micros("ts").alias("t")).agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b")).head()
    for k in range(n):
        low, high = (bounds.a + (bounds.b - bounds.a) * i // n for i in (k, k + 1))
        e.filter(F.unix_micros("ts").between(low, high - 1)).repartition("user_id").write.mode("append").parquet(drops)
    return drops, e.schema


@query("""WITH s AS (SELECT user_id, ts, max(event_id) AS session_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, e.ts, s.session_id, s.ts AS session_ts FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def x3_logon_sessions(spark, sf):
    """Events with the session that a signup opens, held as state over several batches; none ends, and none is late."""
    drops, schema = _waves(spark, sf)
    stream = X.event_stream(spark, drops, schema, files_a_batch=4)
    kind = F.when(F.col("event_type") == "signup", X.LOGON).otherwise(F.col("event_type"))
    with X.timer_store(spark):
        got = _run(spark, X.track_sessions(stream, "user_id", "event_id", "ts", kind, idle="36500 days", delay="3650 days"))
    done, _ = X.split_late(got.filter("event_id IS NOT NULL"))
    return done.select("event_id", ntz(F.col("ts")).alias("ts"), "session_id", ntz(F.col("session_ts")).alias("session_ts"))


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, struct_pack(t := ts, e := event_id)) AS first_value, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_value, count(*) AS rows FROM events GROUP BY user_id""")
def x1_upkeep(spark, sf):
    """First and last events of each user, kept up over batches; after they are merged, the first batch is delivered again."""
    drops, schema = _waves(spark, sf)
    kept, path = U.first_last_kept(["user_id"], "ts", "event_type", "event_id"), scratch(spark)
    U.keep_up(X.event_stream(spark, drops, schema, files_a_batch=8), path, path + "-checkpoint", kept)
    U.compact(spark, path, kept)
    U.take_in(spark.read.schema(schema).parquet(drops), 0, path, kept)
    return U.read_kept(spark, path, kept).withColumns({c: ntz(F.col(c)) for c in ("first_ts", "last_ts")})


@query("""SELECT event_id, epoch_us(ts) * 10 + 116444736000000000 AS ticks, ts AS back, strftime(ts, '%-d/%-m/%Y %-Hh%-Mm%-Ss') AS shown, translate(event_type, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') AS turned FROM events""")
def x4_sql_functions(spark, sf):
    register_functions(spark)
    table(spark, sf, "events").withColumn("ts", utc("ts")).createOrReplaceTempView("_x4_events")
    return spark.sql("""SELECT event_id, af_ts_to_filetime(ts) AS ticks, CAST(af_filetime_to_ts(af_ts_to_filetime(ts)) AS TIMESTAMP_NTZ) AS back,
        af_display_time(ts) AS shown, af_rot13(event_type) AS turned FROM _x4_events""")


@query("SELECT p_partkey // 50 AS list_id, (row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1)::INTEGER AS pos, p_name AS item FROM part")
def x4_table_function(spark, sf):
    register_functions(spark)
    item = F.concat(S.le_bytes(F.octet_length("p_name") + 2, 2), F.col("p_name").cast("binary"))
    d = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 50).alias("list_id"), "p_partkey", F.hex(item).alias("h"))
    g = N.gather(d, ["list_id"], "p_partkey", ["h"], "c")
    g.select("list_id", F.unhex(F.concat(F.array_join(F.transform("c", lambda x: x["h"]), ""), F.lit("0000"))).alias("blob")).createOrReplaceTempView("_x4_blobs")
    return spark.sql("SELECT list_id, t.pos, decode(t.item, 'UTF-8') AS item FROM _x4_blobs, LATERAL af_chain_items(blob) AS t")


@query("""SELECT e.user_id, coalesce(c_name, '') AS user_name, event_type, max(ts) AS last_ts, count(*) AS runs FROM events e LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL""")
def programs_by_user(spark, sf):
    """Which programs each user ran, how often, and when last."""
    runs = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"), F.count("*").alias("runs"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return runs.join(names, "user_id", "left").select("user_id", F.coalesce("user_name", F.lit("")).alias("user_name"), "event_type", "last_ts", "runs")
