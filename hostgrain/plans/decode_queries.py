"""Binary decoders on blobs that are packed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decode as B
from ..operators import lookups as L
from ..operators import nested as N
from .registry import ntz, query, table, utc


def _u(c, n):
    return S.le_bytes(F.lit(c) if isinstance(c, int) else c, n)


def _zeros(n):
    return F.lit(bytes(n))


def _wide(c):
    return F.encode(c, "UTF-16LE")


def _good(df):
    return B.split_errors(df)[0]


def _links(spark, sf):
    """Orders packed as shell links with an item list, link information with a volume, a name and arguments, as column b."""
    o = table(spark, sf, "orders")
    t = S.le_bytes(S.ts_to_filetime(utc("o_orderdate")), 8)
    header = F.concat(F.lit(B.LNK_HEADER), _u(0x1 | 0x2 | 0x4 | 0x20 | 0x80, 4), _u(F.col("o_custkey").bitwiseAND(65535), 4), t, t, t, _u(7, 4), _u(F.col("o_orderkey"), 4), _u(1, 4), _zeros(12))
    ids = F.concat(_u(6, 2), _u(4, 2), F.lit(b"\x61\x00"), _u(0, 2))
    label = F.concat(F.col("o_orderstatus").cast("binary"), _zeros(1))
    volume = F.concat(_u(F.octet_length(label) + 16, 4), _u(3, 4), _u(F.col("o_orderkey"), 4), _u(16, 4), label)
    path = F.concat(F.lit("C:\\"), F.col("o_orderkey").cast("string")).cast("binary")
    at = F.octet_length(volume) + 28
    size = at + F.octet_length(path) + 2
    info = F.concat(_u(size, 4), _u(28, 4), _u(1, 4), _u(28, 4), _u(at, 4), _u(0, 4), _u(size - 1, 4), volume, path, _zeros(2))
    text = lambda c: F.concat(_u(F.length(c), 2), _wide(c))
    args = F.concat(F.lit("-k "), F.col("o_custkey").cast("string"))
    return o.withColumn("b", F.concat(header, ids, info, text(F.col("o_orderpriority")), text(args)))


@query("""SELECT o_orderkey, 167 AS link_flags, o_custkey & 65535 AS attributes, o_orderdate AS created, o_orderkey::INTEGER AS icon_index, 3 AS drive_code,
  lpad(upper(to_hex(o_orderkey)), 8, '0') AS vol_serial, o_orderstatus AS vol_label, 'C:\\' || o_orderkey AS base_path, o_orderpriority AS descr, '-k ' || o_custkey AS args FROM orders""".replace("\\\\", "\\"))
def b1_lnk(spark, sf):
    r = _good(B.decode_lnk(_links(spark, sf).select("o_orderkey", "b"), "b", ["o_orderkey"]))
    return r.select("o_orderkey", F.col("link_flags").cast("int").alias("link_flags"), "attributes", ntz(S.filetime_to_ts(F.col("created_ticks"))).alias("created"), "icon_index", F.col("drive_code").cast("int").alias("drive_code"), "vol_serial", "vol_label", "base_path", "descr", "args")


@query("""SELECT l_orderkey, 'ORDER.EXE' AS name, lpad(upper(to_hex(l_orderkey)), 8, '0') AS hash, (count(*) + 5)::INTEGER AS run_count, least(count(*), 8)::INTEGER AS n_runs,
  list('\\VOL\\' || l_partkey ORDER BY l_linenumber, l_partkey) AS files, '\\VOL' AS device, ['\\VOL\\D'] AS dirs FROM lineitem GROUP BY l_orderkey""".replace("\\\\", "\\"))
def b2_prefetch(spark, sf):
    """Orders packed as prefetch bodies: lines as referenced files and run times, one volume."""
    li = table(spark, sf, "lineitem")
    d = N.gather(li.withColumn("t", S.ts_to_filetime(utc("l_shipdate"))), ["l_orderkey"], "l_linenumber", ["l_partkey", "t"], "c")
    names = _wide(F.concat(F.array_join(F.transform("c", lambda x: F.concat(F.lit("\\VOL\\"), x["l_partkey"].cast("string"))), "\0"), F.lit("\0")))
    run = lambda k: F.coalesce(S.le_bytes(F.get("c", F.lit(k))["t"], 8), _zeros(8))
    head = F.concat(_u(30, 4), F.lit(b"SCCA"), _zeros(8), F.rpad(_wide(F.lit("ORDER.EXE")), 60, F.lit(b"\0")), _u(F.col("l_orderkey"), 4), _zeros(4))
    at = 304
    n = F.octet_length(names)
    info = F.concat(_zeros(16), _u(at, 4), _u(n, 4), _u(n + at, 4), _u(1, 4), _zeros(12), *(run(k) for k in range(8)), _zeros(8), _u(F.size("c") + 5, 4), _u(1, 4), _zeros(220 - 124))
    device, folder = _wide(F.lit("\\VOL")), _wide(F.lit("\\VOL\\D"))
    volume = F.concat(_u(96, 4), _u(4, 4), _u(F.lit(0), 8), _u(F.col("l_orderkey"), 4), _zeros(8), _u(106, 4), _u(1, 4), _zeros(60), device, _zeros(2), _u(6, 2), folder, _zeros(2))
    r = _good(B.decode_prefetch(d.select("l_orderkey", F.concat(head, info, names, volume).alias("b")), "b", ["l_orderkey"]))
    v = F.get("volumes", F.lit(0))
    return r.select("l_orderkey", "name", "hash", F.col("run_count").cast("int").alias("run_count"), F.size("runs").alias("n_runs"), "files", v["device"].alias("device"), v["dirs"].alias("dirs"))


@query("SELECT p_partkey // 50 AS list_id, p_name AS path, p_partkey * 10000000 + 116444736000000000 AS ticks, p_size % 2 = 1 AS executed FROM part")
def b3_shimcache(spark, sf):
    """Parts packed into cache blobs, some records with data and some without."""
    return _good(B.decode_shimcache(_caches(spark, sf), "b", ["list_id"])).select("list_id", "path", "ticks", "executed")


def _caches(spark, sf):
    name = _wide(F.col("p_name"))
    data = F.when(F.col("p_size") % 2 == 1, F.concat(_u(4, 4), _u(1, 4))).otherwise(F.concat(_u(0, 4)))
    record = F.concat(F.lit(b"10ts"), _zeros(8), _u(F.octet_length(name), 2), name, _u(S.unix_to_filetime(F.col("p_partkey")), 8), data)
    d = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 50).alias("list_id"), "p_partkey", F.hex(record).alias("h"))
    g = N.gather(d, ["list_id"], "p_partkey", ["h"], "c")
    blob = F.unhex(F.concat(F.hex(F.concat(_u(52, 4), _zeros(48))), F.array_join(F.transform("c", lambda x: x["h"]), "")))
    return g.select("list_id", blob.alias("b"))


@query("SELECT c_custkey, c_custkey AS entry_no, c_mktsegment AS host, c_name AS path, c_acctbal >= 0 AS pinned FROM customer")
def b4_destlist(spark, sf):
    c = table(spark, sf, "customer")
    host = F.substring(F.concat(F.col("c_mktsegment").cast("binary"), _zeros(16)), 1, 16)
    pin = F.when(F.col("c_acctbal") >= 0, 0).otherwise(-1)
    entry = F.concat(_zeros(72), host, _u(F.col("c_custkey"), 4), _zeros(16), _u(pin, 4), _zeros(16), _u(F.length("c_name"), 2), _wide(F.col("c_name")), _zeros(4))
    d = c.select("c_custkey", F.concat(_u(4, 4), _u(1, 4), _zeros(24), entry).alias("b"))
    return _good(B.decode_destlist(d, "b", ["c_custkey"])).select("c_custkey", "entry_no", "host", "path", "pinned")


@query("""SELECT p_partkey // 20 AS list_id, (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1)::INTEGER AS pos, 'FileEntry' AS type, 'P' || p_partkey AS name, p_size::BIGINT AS size,
  p_name AS long_name, make_timestamp(2001, 2, 3, 4, 6, 8) AS modified FROM part""")
def b5_shell_items(spark, sf):
    r = _items(spark, sf)
    return r.select("list_id", "pos", "type", "name", "size", F.get("blocks", F.lit(0))["text"].alias("long_name"), ntz(S.fat_to_ts(F.col("modified_fat"))).alias("modified"))


@query("SELECT p_partkey // 20 AS list_id, 'beef0004' AS signature, p_name AS long_name, make_timestamp(2001, 2, 3, 4, 6, 8) AS created FROM part")
def b6_extension_blocks(spark, sf):
    r = _items(spark, sf).select("list_id", F.explode("blocks").alias("b"))
    return r.select("list_id", "b.signature", F.col("b.text").alias("long_name"), ntz(S.fat_to_ts(F.col("b.created_fat"))).alias("created"))


def _items(spark, sf):
    """Parts packed as file entries with an extension block that holds the long name."""
    fat = _u(((4 << 11 | 6 << 5 | 4) << 16) | (21 << 9 | 2 << 5 | 3), 4)
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("\0")).cast("binary")
    name = F.when(F.octet_length(name) % 2 == 1, F.concat(name, _zeros(1))).otherwise(name)
    first = F.octet_length(name) + 14
    long = F.concat(_wide(F.concat("p_name", F.lit("\0"))))
    block = F.concat(_u(F.octet_length(long) + 22, 2), _u(3, 2), F.unhex(F.lit("0400EFBE")), fat, fat, _u(20, 2), _u(0, 2), long, _u(first, 2))
    item = F.concat(_u(first + F.octet_length(block), 2), F.lit(b"\x32\x00"), _u(F.col("p_size"), 4), fat, _u(32, 2), name, block)
    d = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("list_id"), "p_partkey", F.hex(item).alias("h"))
    g = N.gather(d, ["list_id"], "p_partkey", ["h"], "c")
    return _good(B.decode_shell_items(g.select("list_id", F.unhex(F.concat(F.array_join(F.transform("c", lambda x: x["h"]), ""), F.lit("0000"))).alias("b")), "b", ["list_id"]))


@query("SELECT s_suppkey, 2 AS id, 'VT_I4' AS vt, s_nationkey::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, 3, 'VT_LPWSTR', s_name FROM supplier")
def b7_properties(spark, sf):
    number = F.concat(_u(2, 4), _zeros(1), _u(3, 2), _u(0, 2), _u(F.col("s_nationkey"), 4))
    text = F.concat(_u(3, 4), _zeros(1), _u(31, 2), _u(0, 2), _u(F.length("s_name") + 1, 4), _wide(F.concat("s_name", F.lit("\0"))))
    values = F.concat(*(F.concat(_u(F.octet_length(v) + 4, 4), v) for v in (number, text)), _u(0, 4))
    store = F.concat(_u(F.octet_length(values) + 24, 4), F.lit(b"1SPS"), F.unhex(F.md5("s_name")), values, _u(0, 4))
    r = _good(B.decode_properties(table(spark, sf, "supplier").select("s_suppkey", store.alias("b")), "b", ["s_suppkey"]))
    return r.select("s_suppkey", F.col("property_id").cast("int").alias("id"), S.vt_name(F.col("vt")).alias("vt"), "value")


def _typed(id, vt, *parts):
    value = F.concat(_u(id, 4), _zeros(1), _u(vt, 2), _u(0, 2), *parts)
    return F.concat(_u(F.octet_length(value) + 4, 4), value)


def _store(guid, *values):
    every = F.concat(*values, _u(0, 4))
    return F.concat(_u(F.octet_length(every) + 24, 4), F.lit(b"1SPS"), guid, every)


@query("""SELECT s_suppkey, 2 AS id, 'VT_VECTOR | VT_UI4' AS vt, '["' || s_suppkey || '", "' || s_nationkey || '"]' AS value FROM supplier
UNION ALL SELECT s_suppkey, 3, 'VT_VECTOR | VT_LPWSTR', '["' || s_name || '", "ab"]' FROM supplier
UNION ALL SELECT s_suppkey, 4, 'VT_DATE', '1900-01-' || lpad((s_nationkey % 25 + 1)::VARCHAR, 2, '0') || ' 00:00:00' FROM supplier
UNION ALL SELECT s_suppkey, 5, 'VT_CY', s_suppkey || '.5000' FROM supplier""")
def b7_vectors(spark, sf):
    """Vectors of numbers and texts, dates and currencies. A date is a double: a whole number of days is packed by its bits."""
    n = F.col("s_nationkey") % 25 + 2  # days since 1899-12-30
    power = F.floor(F.log2(n + F.lit(0.5)))  # n is no power of two and a half
    bits = F.shiftleft((power + 1023).cast("long"), 52) + ((n / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0 ** 52)).cast("long")
    texts = [F.concat(_u(F.length(t) + 1, 4), _wide(F.concat(t, F.lit("\0")))) for t in (F.col("s_name"), F.lit("ab"))]
    padded = [F.when(F.octet_length(t) % 4 == 2, F.concat(t, _zeros(2))).otherwise(t) for t in texts]
    store = _store(
        F.unhex(F.md5("s_name")), _typed(2, 0x1013, _u(2, 4), _u(F.col("s_suppkey"), 4), _u(F.col("s_nationkey"), 4)), _typed(3, 0x101F, _u(2, 4), *padded),
        _typed(4, 7, S.le_bytes(bits, 8)), _typed(5, 6, S.le_bytes(F.col("s_suppkey") * 10000 + 5000, 8)),
    )
    r = _good(B.decode_properties(table(spark, sf, "supplier").select("s_suppkey", F.concat(store, _u(0, 4)).alias("b")), "b", ["s_suppkey"]))
    return r.select("s_suppkey", F.col("property_id").cast("int").alias("id"), S.vt_name(F.col("vt")).alias("vt"), "value")


@query("""SELECT s_suppkey, 'Programs' AS category, 'beef0021' AS signature, s_nationkey::VARCHAR AS value, NULL AS guid2 FROM supplier
UNION ALL SELECT s_suppkey, 'Programs', 'beef0000', NULL, '{00000000-0000-0000-0000-' || lpad(to_hex(s_suppkey), 12, '0') || '}' FROM supplier""")
def b6_stores(spark, sf):
    """Suppliers packed as control-panel categories with two blocks, one that holds a property store and one of two GUIDs."""
    store = F.concat(_store(F.unhex(F.md5("s_name")), _typed(2, 3, _u(F.col("s_nationkey"), 4))), _u(0, 4))
    first = F.concat(_u(F.octet_length(store) + 10, 2), _u(1, 2), F.unhex(F.lit("2100EFBE")), store, _zeros(2))
    second = F.concat(_u(42, 2), _u(1, 2), F.unhex(F.lit("0000EFBE")), _zeros(26), F.unhex(F.lpad(F.hex("s_suppkey"), 12, "0")), _zeros(2))
    item = F.concat(_u(F.octet_length(first) + F.octet_length(second) + 12, 2), F.lit(b"\x01\x00"), _zeros(4), _u(8, 4), first, second)
    r = _good(B.decode_shell_items(table(spark, sf, "supplier").select("s_suppkey", F.concat(item, _u(0, 2)).alias("b")), "b", ["s_suppkey"]))
    d = r.select("s_suppkey", L.code_label("control_panel", F.col("category")).alias("category"), F.explode("blocks").alias("k"))
    return d.select("s_suppkey", "category", "k.signature", F.get("k.properties", F.lit(0))["value"].alias("value"), "k.guid2")


@query("SELECT event_id, event_type AS name, user_id::INTEGER AS count, ts AS last_ts, ts AS bam_ts FROM events")
def b8_fixed_values(spark, sf):
    e = table(spark, sf, "events")
    ticks = S.le_bytes(S.ts_to_filetime(F.col("ts")), 8)
    data = F.concat(_zeros(4), _u(F.col("user_id"), 4), _zeros(52), ticks)
    c = B.userassist_columns(S.rot13(F.col("event_type")), data)
    return e.select("event_id", c["name"].alias("name"), c["count"].alias("count"), ntz(c["last_ts"]).alias("last_ts"), ntz(B.bam_time(ticks)).alias("bam_ts"))
