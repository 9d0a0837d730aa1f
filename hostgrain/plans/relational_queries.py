"""Queries for predicates, joins, aggregation, windows, set operations and nesting."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lookups as L
from ..operators import nested as N
from ..operators import predicates as P
from .registry import query, table


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def p1_value_type(spark, sf):
    return P.of_type(table(spark, sf, "events"), "event_type", "click").select("event_id", "user_id", "value")


@query("SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z]+)$', 1)) IN ('html', 'htm')".replace("\\\\", "\\"))
def p2_extension(spark, sf):
    return P.with_extension(table(spark, sf, "pages"), "url", "html", "htm").select("page_id", "url")


@query("""SELECT user_id, list_filter(list(CASE WHEN event_type = 'error' THEN 0 ELSE event_id END ORDER BY event_id), lambda t: t <> 0) AS runs FROM events GROUP BY user_id""")
def p3_drop_zero(spark, sf):
    t = F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id"))
    return N.gather_where(table(spark, sf, "events").select("user_id", t.alias("t")), ["user_id"], F.col("t") != 0, ["t"], "runs")


@query("SELECT l_orderkey, l_linenumber, l_linenumber >= 3 AS good FROM lineitem")
def p4_version_gate(spark, sf):
    from ..sources.artefacts import gate

    good, bad = gate(table(spark, sf, "lineitem"), F.col("l_linenumber") >= 3, "version")
    keep = ["l_orderkey", "l_linenumber"]
    return good.select(*keep, F.lit(True).alias("good")).unionByName(bad.select(*keep, F.lit(False).alias("good")))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, (SELECT min(p_name)[1:2] FROM part))")
def p5_signature_gate(spark, sf):
    d = table(spark, sf, "part")
    head = d.agg(F.substring(F.min("p_name"), 1, 2).cast("binary").alias("sig"))
    return d.crossJoin(F.broadcast(head)).filter(P.has_signature(F.col("p_name"), F.col("sig"))).select("p_partkey", "p_name")


@query("""WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN list_position(t, 'error') IS NULL OR list_position(t, 'error') = 0 THEN t ELSE t[1 : list_position(t, 'error') - 1] END AS kept FROM a""")
def p6_take_until(spark, sf):
    d = N.before_stop(table(spark, sf, "events"), ["user_id"], [F.col("event_id")], F.col("event_type") == "error")
    g = N.gather_where(d, ["user_id"], F.col("before"), ["event_id", "event_type"], "all")
    return g.select("user_id", F.transform("all", lambda x: x["event_type"]).alias("kept"))


@query("SELECT doc_id, try_cast(source[4:] AS INTEGER) AS number, try_cast(source[4:] AS INTEGER) IS NULL AS quarantined FROM documents")
def p7_quarantine(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring("source", 4, 100).alias("text"))
    return P.quarantine(d, "text", "int", "number").select("doc_id", "number", F.col("reason").isNotNull().alias("quarantined"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def p8_with_profile(spark, sf):
    return P.with_profile(table(spark, sf, "customer"), F.col("c_acctbal") > 0).select("c_custkey", "c_name")


@query("SELECT o_orderkey, coalesce(c_name, '') AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")
def j1_sid_name(spark, sf):
    users = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.lit("h").alias("host"), F.col("c_custkey").cast("string").alias("sid"), F.col("c_name").alias("name"))
    d = table(spark, sf, "orders").select("o_orderkey", F.lit("h").alias("host"), F.col("o_custkey").cast("string").alias("sid"))
    return L.sid_names(d, users, out="owner").select("o_orderkey", "owner")


@query("SELECT c_custkey, r_name FROM customer, region")
def j2_expected_keys(spark, sf):
    return L.expected_keys(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "region").select("r_name"))


@query("""SELECT s_suppkey, coalesce(n_name, 'BAD TYPE') AS nation, coalesce(r_name, 'UNKNOWN') AS region
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey <> 3 LEFT JOIN region ON n_regionkey = r_regionkey""")
def j3_code_label(spark, sf):
    nation = table(spark, sf, "nation").filter("n_nationkey <> 3")
    d = L.label_join(table(spark, sf, "supplier"), "s_nationkey", nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")), "BAD TYPE", "nation")
    keys = L.label_join(d, "s_nationkey", nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("label")), "-1", "region_code")
    keys = keys.withColumn("region_code", F.col("region_code").cast("int"))
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return L.label_join(keys, "region_code", region, "UNKNOWN", "region").select("s_suppkey", "nation", "region")


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_name, '(Undefined)') AS property FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND l_linenumber = p_size % 7 + 1""")
def j4_property_name(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("guid"), (F.col("p_size") % 7 + 1).alias("id"), F.col("p_name").alias("name"))
    d = table(spark, sf, "lineitem").withColumn("guid", F.col("l_partkey").cast("string"))
    return L.property_names(d, "guid", "l_linenumber", names).select("l_orderkey", "l_linenumber", "property")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j5_entry_streams(spark, sf):
    e = table(spark, sf, "orders").select(F.lit("f").alias("file"), "o_orderkey", F.col("o_orderkey").alias("entry_no"))
    s = table(spark, sf, "lineitem").select(F.lit("f").alias("file"), F.upper(F.hex("l_orderkey")).alias("stream"), "l_linenumber", "l_quantity")
    return L.entry_streams(e, s, ["file"]).select("o_orderkey", "l_linenumber", "l_quantity")


@query("""WITH j AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS miss FROM events)
SELECT user_id, event_id FROM j WHERE miss = 0""")
def j5_stop_at_gap(spark, sf):
    """The reading that stops at a user's first entry without a stream."""
    d = table(spark, sf, "events")
    e = d.select("user_id", "event_id", F.col("event_id").alias("entry_no"))
    s = d.filter("event_type <> 'error'").select("user_id", F.hex("event_id").alias("stream"))
    return L.entry_streams(e, s, ["user_id"], stop_at_gap="event_id").select("user_id", "event_id")


@query("""WITH w AS (SELECT DISTINCT regexp_extract(p_name, '^[^ ]+', 0)[1:4] AS prefix FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, p_name, min(prefix) AS volume FROM part LEFT JOIN w ON starts_with(p_name, prefix) GROUP BY ALL""")
def j6_prefix_join(spark, sf):
    d = table(spark, sf, "part")
    dim = d.filter("p_partkey % 2 = 0").select(F.substring(F.regexp_extract("p_name", "^[^ ]+", 0), 1, 4).alias("volume")).distinct()
    return L.prefix_join(d.select("p_partkey", "p_name"), "p_name", dim, "volume", "volume").select("p_partkey", "p_name", "volume")


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN n_name END, '') AS mount FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j7_mount_points(spark, sf):
    """Serials in their unpadded spelling against a table with padded ones. A host has 4,096 of them, within which that spelling is
    unique: the third byte has one digit in all, or two."""
    s = table(spark, sf, "supplier").withColumn("host", F.expr("concat('h', s_suppkey DIV 4096)"))
    padded = F.lpad(F.hex("s_suppkey"), 8, "0")
    v = s.filter("s_suppkey % 2 = 0").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("host", padded.alias("serial"), F.col("n_name").alias("letter"))
    d = s.select("s_suppkey", "host", F.lower(S.serial_unpadded(padded)).alias("serial"))
    return L.mount_points(d, "serial", v).select("s_suppkey", "mount")


@query("SELECT l.doc_id, coalesce(md5(text), '') AS md5 FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.doc_id % 5 <> 0")
def j8_file_md5(spark, sf):
    h = table(spark, sf, "documents").filter("doc_id % 5 <> 0").select(F.lit("h").alias("host"), F.concat(F.lit("c:\\"), F.col("doc_id").cast("string")).alias("path_norm"), F.md5("text").alias("md5"))
    d = table(spark, sf, "labels").select("doc_id", F.lit("h").alias("host"), F.concat(F.lit("C:\\"), F.col("doc_id").cast("string")).alias("path"))
    return L.file_md5(d, "path", h).select("doc_id", "md5")


@query("SELECT c_custkey, coalesce(n_name, '') AS profile FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def j9_profile(spark, sf):
    reg = table(spark, sf, "nation").filter("n_nationkey < 20").select(
        F.lit("h").alias("host"), F.concat(F.lit("Software\\ProfileList\\S-1-5-"), F.col("n_nationkey").cast("string")).alias("key_path"),
        F.lit("ProfileImagePath").alias("value_name"), F.encode(F.concat("n_name", F.lit("\0")), "UTF-16LE").alias("data"),
    )
    users = table(spark, sf, "customer").select("c_custkey", F.lit("h").alias("host"), F.concat(F.lit("S-1-5-"), F.col("c_nationkey").cast("string")).alias("sid"))
    return L.profile_paths(users, reg).select("c_custkey", "profile")


@query("SELECT c.p_partkey, p.p_name AS parent_p_name FROM part c LEFT JOIN part p ON c.p_partkey // 10 = p.p_partkey")
def j10_parent(spark, sf):
    d = table(spark, sf, "part").select(F.lit("h").alias("host"), "p_partkey", "p_name", F.floor(F.col("p_partkey") / 10).alias("up"))
    return L.with_parent(d, ["host"], "p_partkey", "up", ["p_name"]).select("p_partkey", "parent_p_name")


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def a1_gather(spark, sf):
    g = N.gather(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_partkey"], "c")
    return g.select("l_orderkey", F.transform("c", lambda x: x["l_partkey"]).alias("parts"))


@query("SELECT conv_id, count(*)::INTEGER AS turns FROM conversations GROUP BY conv_id")
def a2_count_children(spark, sf):
    g = N.gather(table(spark, sf, "conversations"), ["conv_id"], "turn", ["role"], "c")
    return g.select("conv_id", F.size("c").alias("turns"))


@query("""WITH m AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN struct_pack(n := l_linenumber, p := l_partkey) END) AS m FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, m.p AS last_returned FROM m""")
def a3_last_match(spark, sf):
    g = N.gather(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_partkey", "l_returnflag"], "c")
    return g.select("l_orderkey", N.last_match(F.col("c"), lambda x: x["l_returnflag"] == "R")["l_partkey"].alias("last_returned"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_partkey ELSE l_suppkey END AS run_count FROM lineitem")
def a4_conditional_counter(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.counter(F.col("l_linestatus") == "O", "l_partkey", "l_suppkey").alias("run_count"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1)::INTEGER AS rank FROM events")
def w1_mru_rank(spark, sf):
    return N.mru_rank(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "rank")


@query("""SELECT conv_id, turn, coalesce(bool_or(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_system FROM conversations""")
def w2_seen_before(spark, sf):
    return N.seen_before(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "system", "after_system").select("conv_id", "turn", "after_system")


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) AS in_order FROM events GROUP BY user_id")
def o1_source_order(spark, sf):
    g = N.gather(table(spark, sf, "events"), ["user_id"], "ts", ["event_id"], "c")
    return g.select("user_id", F.transform("c", lambda x: x["event_id"]).alias("in_order"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 8")
def o2_eight_runs(spark, sf):
    return N.mru_rank(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).filter("rank < 8").select("user_id", "event_id")


@query("""SELECT event_id, value, 'Run' AS source FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value, 'RunOnce' FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, NULL, 'HKLM' FROM events WHERE event_type = 'signup'""")
def u1_tagged_union(spark, sf):
    d = table(spark, sf, "events")
    one = lambda t: d.filter(F.col("event_type") == t)
    return N.tagged_union({"Run": one("click").select("event_id", "value"), "RunOnce": one("view").select("event_id", "value"), "HKLM": one("signup").select("event_id")})


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos, unnest(embedding) AS item FROM embeddings")
def n1_flatten(spark, sf):
    return N.flatten(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")


@query("""WITH RECURSIVE t AS (
  SELECT p_partkey, p_partkey::VARCHAR AS path, 0 AS depth, p_partkey AS root FROM part WHERE p_partkey // 10 = p_partkey OR p_partkey // 10 NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT c.p_partkey, t.path || '\\' || c.p_partkey::VARCHAR, t.depth + 1, t.root FROM part c JOIN t ON c.p_partkey // 10 = t.p_partkey AND c.p_partkey <> t.p_partkey)
SELECT p_partkey, path, depth, root FROM t""".replace("\\\\", "\\"))
def n2_tree(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("up"))
    return N.tree_paths(d, [], "p_partkey", "up", "p_partkey")


@query("""SELECT c_nationkey, c_nationkey || '/' || c_custkey AS node_path, 1 AS depth, c_nationkey::VARCHAR AS parent, c_name AS name FROM customer
UNION ALL SELECT DISTINCT c_nationkey, c_nationkey::VARCHAR, 0, NULL, NULL FROM customer""")
def n2_variant_tree(spark, sf):
    """Nested JSON, a node of each nation with its customers as children, walked as variants."""
    kids = F.collect_list(F.struct(F.col("c_custkey").alias("ID"), F.col("c_name").alias("name")))
    some = F.floor(F.col("c_custkey") / 1000).alias("some")  # so many children a text; a nation has several texts with one root
    d = table(spark, sf, "customer").groupBy("c_nationkey", some).agg(F.to_json(F.struct(F.first("c_nationkey").alias("ID"), kids.alias("Childs"))).alias("j"))
    out = N.variant_tree(d, "j", ["c_nationkey"], "Childs", {"name": "string"})
    return out.filter("depth > 0").unionByName(out.filter("depth = 0").distinct())


@query("SELECT p_partkey // 50 AS list_id, (row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1)::INTEGER AS pos, p_name AS item FROM part")
def n3_size_chain(spark, sf):
    """Items packed into one blob with 16-bit sizes and a terminator, walked back into rows."""
    from ..operators.decode import walk_chain

    item = F.concat(S.le_bytes(F.octet_length("p_name") + 2, 2), F.col("p_name").cast("binary"))
    d = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 50).alias("list_id"), "p_partkey", F.hex(item).alias("h"))
    g = N.gather(d, ["list_id"], "p_partkey", ["h"], "c")
    blob = F.unhex(F.concat(F.array_join(F.transform("c", lambda x: x["h"]), ""), F.lit("0000FFFF")))
    out = walk_chain(g.select("list_id", blob.alias("blob")), "blob", ["list_id"])
    return out.select("list_id", "pos", F.decode("item", "UTF-8").alias("item"))


@query("""WITH s AS (SELECT doc_id, string_split(text, 'the') AS p FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM s)
SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + 3 * (i - 1))::INTEGER AS start FROM e""")
def n4_token_positions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(N.token_positions(F.col("text"), "the")).alias("start"))


@query("SELECT doc_id, 'root\\' || lang || '\\' || source AS path FROM documents".replace("\\\\", "\\"))
def n5_folder_paths(spark, sf):
    """Documents in folders of their language below one root."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    of = d.filter("lang IS NOT NULL").select(F.col("lang").alias("id"), F.lit("/").alias("parent"), F.col("lang").alias("label")).distinct()
    folders = of.unionByName(table(spark, sf, "region").select(F.lit("/").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("label")).distinct())
    return N.folder_paths(d, folders, [], "lang", "source").select("doc_id", "path")
