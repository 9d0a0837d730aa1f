"""One query for each scalar function, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import ntz, query, table, utc

E = S.EPOCH_TICKS


@query(f"SELECT event_id, epoch_us(ts) * 10 + {E} AS ticks, ts AS back FROM events")
def fn_filetime(spark, sf):
    d = table(spark, sf, "events").withColumn("ticks", S.ts_to_filetime(utc("ts")))
    return d.select("event_id", "ticks", ntz(S.filetime_to_ts(F.col("ticks"))).alias("back"))


@query(f"SELECT event_id, (epoch_us(ts) // 1000000) * 10000000 + {E} AS ticks FROM events")
def fn_unix_filetime(spark, sf):
    return table(spark, sf, "events").select("event_id", S.unix_to_filetime(F.unix_seconds(utc("ts"))).alias("ticks"))


@query("""SELECT event_id, (((hour(ts) << 11) + (minute(ts) << 5) + second(ts) // 2) << 16) + ((year(ts) - 1980) << 9) + (month(ts) << 5) + day(ts) AS packed,
  date_trunc('minute', ts) + to_seconds(second(ts) // 2 * 2) AS back FROM events""")
def fn_fat_time(spark, sf):
    d = table(spark, sf, "events").withColumn("packed", S.ts_to_fat(utc("ts")))
    return d.select("event_id", "packed", ntz(S.fat_to_ts(F.col("packed"))).alias("back"))


@query("SELECT event_id, strftime(ts, '%-d/%-m/%Y %-Hh%-Mm%-Ss') AS shown FROM events")
def fn_display_time(spark, sf):
    return table(spark, sf, "events").select("event_id", S.display_time(utc("ts")).alias("shown"))


@query("SELECT event_id, date_trunc('second', ts) AS parsed, NULL::TIMESTAMP AS parsed_empty FROM events")
def fn_parse_display_time(spark, sf):
    d = table(spark, sf, "events").select("event_id", S.display_time(utc("ts")).alias("t"))
    return d.select("event_id", ntz(S.parse_display_time(F.col("t"))).alias("parsed"), ntz(S.parse_display_time(F.substring("t", 1, 0))).alias("parsed_empty"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%m/%d/%Y %H:%M:%S') AS shown, date_trunc('second', l_shipdate) AS parsed FROM lineitem")
def fn_us_date(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("shown", F.date_format(utc("l_shipdate"), S.US_FORMAT))
    return d.select("l_orderkey", "l_linenumber", "shown", ntz(S.parse_us_date(F.col("shown"))).alias("parsed"))


@query("SELECT event_id, ts + INTERVAL 120 MINUTE AS east, ts - INTERVAL 300 MINUTE AS west FROM events")
def fn_local_time(spark, sf):
    t = utc("ts")
    return table(spark, sf, "events").select("event_id", ntz(S.utc_to_local(t, F.lit(-120))).alias("east"), ntz(S.utc_to_local(t, F.lit(300))).alias("west"))


@query("SELECT o_orderkey, o_orderdate AS back FROM orders")
def fn_ole_date(spark, sf):
    days = F.unix_micros(utc("o_orderdate")) / F.lit(86_400_000_000.0) + S.OLE_EPOCH_DAYS
    return table(spark, sf, "orders").select("o_orderkey", ntz(F.date_trunc("second", S.ole_to_ts(days) + F.expr("INTERVAL 500 MILLISECONDS"))).alias("back"))


@query("""SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS turned, p_name AS back FROM part""")
def fn_rot13(spark, sf):
    r = S.rot13(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", r.alias("turned"), S.rot13(r).alias("back"))


@query("SELECT page_id, url_encode(url || '?a+b c') AS encoded, url || '?a+b c' AS decoded, url || '+' AS plus FROM pages")
def fn_percent_decode(spark, sf):
    e = F.replace(F.url_encode(F.concat("url", F.lit("?a+b c"))), F.lit("+"), F.lit("%20"))
    return table(spark, sf, "pages").select("page_id", e.alias("encoded"), S.percent_decode(e).alias("decoded"), S.percent_decode(F.concat("url", F.lit("+"))).alias("plus"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(13), '\r'), chr(10), '\n'), chr(9), '\t') AS escaped FROM documents""")
def fn_json_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.json_escape(F.col("text")).alias("escaped"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey < 16 THEN '0' ELSE '' END || lower(to_hex(l_orderkey)) AS hex_key, '0' || lower(to_hex(l_linenumber)) AS hex_line FROM lineitem")
def fn_hex_text(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.hex_text(F.col("l_orderkey")).alias("hex_key"), S.hex_text(F.col("l_linenumber")).alias("hex_line"))


@query("SELECT p_partkey, rtrim(regexp_replace(lower(hex(encode(p_name))), '(..)', '\\1 ', 'g')) AS dump FROM part".replace("\\\\", "\\"))
def fn_hex_dump(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.hex_dump(F.col("p_name").cast("binary")).alias("dump"))


@query("SELECT doc_id, upper(md5(text)) AS md5 FROM documents")
def fn_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.md5_upper(F.col("text")).alias("md5"))


@query("""WITH m AS (SELECT p_partkey, upper(md5(p_name)) AS h FROM part)
SELECT p_partkey, '{' || h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] || '}' AS guid, h AS back FROM m""")
def fn_guid(spark, sf):
    g = S.guid_text(F.unhex(F.md5("p_name")))
    return table(spark, sf, "part").select("p_partkey", g.alias("guid"), F.hex(S.guid_bytes(g)).alias("back"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '{00000000-0000-0000-0000-' || lpad((c_nationkey)::VARCHAR, 12, '0') || '}' END || '\\' || c_name AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey""".replace("\\\\", "\\"))
def fn_guid_replace(spark, sf):
    """The first GUID of a text gives way to its label; those without a label stay."""
    from ..operators.lookups import replace_guids

    guid = lambda c: F.concat(F.lit("{00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"), F.lit("}"))
    names = table(spark, sf, "nation").select(guid(F.col("n_nationkey")).alias("guid"), F.col("n_name").alias("name"))
    even = F.col("c_custkey") % 2 == 0
    # Odd customers carry a GUID that is in no table and is put back afterwards.
    g = F.when(even, guid(F.col("c_nationkey"))).otherwise(guid(F.col("c_nationkey") + 1000))
    d = table(spark, sf, "customer").select("c_custkey", F.concat(g, F.lit("\\"), "c_name").alias("path"), "c_nationkey")
    out = replace_guids(d, "path", names)
    return out.select("c_custkey", F.when(even, F.col("path")).otherwise(F.replace("path", guid(F.col("c_nationkey") + 1000), guid(F.col("c_nationkey")))).alias("path"))


_ATTR = ", ".join(f"CASE WHEN l_quantity::BIGINT * 37 & {m} <> 0 THEN '{n}' END" for m, n in S.FILE_ATTRIBUTES)
_LINK = ", ".join(f"CASE WHEN l_partkey & {m} <> 0 THEN '{n}' END" for m, n in S.LINK_FLAGS)


@query(f"SELECT l_orderkey, l_linenumber, coalesce(concat_ws(', ', {_ATTR}), '') AS attributes, coalesce(concat_ws(', ', {_LINK}), '') AS link_flags FROM lineitem")
def fn_flags(spark, sf):
    a = S.flag_names(F.col("l_quantity").cast("long") * 37, S.FILE_ATTRIBUTES)
    k = S.flag_names(F.col("l_partkey"), S.LINK_FLAGS)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(a, ", ").alias("attributes"), F.array_join(k, ", ").alias("link_flags"))


_FS = ", ".join(f"CASE WHEN l_partkey & {m} <> 0 THEN '{n}' END" for m, n in S.FS_FLAGS)
_VOLUME = " ".join(f"WHEN {k} THEN '{n}'" for k, n in S.VOLUME_FLAGS.items())


@query(f"SELECT l_orderkey, l_linenumber, coalesce(concat_ws(', ', {_FS}), '') AS fs_flags, CASE l_partkey & {S.VOLUME_MASK} {_VOLUME} END AS volume_flag FROM lineitem")
def fn_item_flags(spark, sf):
    fs = F.array_join(S.flag_names(F.col("l_partkey"), S.FS_FLAGS), ", ").alias("fs_flags")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fs, S.masked_name(F.col("l_partkey"), S.VOLUME_MASK, S.VOLUME_FLAGS).alias("volume_flag"))


@query("SELECT doc_id, lower(lang) AS a, source AS b, 2::INTEGER AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def fn_multi_sz(spark, sf):
    d = table(spark, sf, "documents").dropna(subset=["lang", "source"])
    m = S.multi_sz(F.encode(F.concat("lang", F.lit("\0\0"), "source", F.lit("\0\0")), "UTF-16LE"))
    return d.select("doc_id", F.get(m, F.lit(0)).alias("a"), F.get(m, F.lit(1)).alias("b"), F.size(m).alias("n"))


@query("SELECT p_partkey, p_name AS wide, p_name AS narrow FROM part")
def fn_utf16(spark, sf):
    z = F.concat("p_name", F.lit("\0rest"))
    return table(spark, sf, "part").select("p_partkey", S.utf16_z(F.encode(z, "UTF-16LE")).alias("wide"), S.ansi_z(F.encode(z, "US-ASCII")).alias("narrow"))


@query("""SELECT o_orderkey, o_orderkey & 65535 AS u16, o_orderkey & 4294967295 AS u32, -(o_orderkey % 1000) - 1 AS i32, o_orderkey * 1000003 AS u64, NULL::BIGINT AS past FROM orders""")
def fn_le_int(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select("o_orderkey", F.concat(S.le_bytes(k, 2), S.le_bytes(k, 4), S.le_bytes(-(k % 1000) - 1, 4), S.le_bytes(k * 1_000_003, 8)).alias("b"))
    b = F.col("b")
    return d.select("o_orderkey", S.le_uint(b, 0, 2).alias("u16"), S.le_uint(b, 2, 4).alias("u32"), S.le_int(b, 6, 4).alias("i32"), S.le_uint(b, 10, 8).alias("u64"), S.le_uint(b, 15, 4).alias("past"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS shown, toxic = 1 AS back, NULL::BOOLEAN AS other FROM labels")
def fn_bool(spark, sf):
    t = S.bool_text(F.col("toxic") == 1)
    return table(spark, sf, "labels").select("doc_id", t.alias("shown"), S.text_bool(t).alias("back"), S.text_bool(F.concat(t, F.lit("?"))).alias("other"))


@query("SELECT page_id, replace(url, 'example.com', 'C:') AS path FROM pages")
def fn_rewrite_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.rewrite_path(F.col("url"), F.lit("example.com"), F.lit("C:")).alias("path"))


@query("""SELECT page_id, list_last(string_split(replace(url, '/', '\\'), '\\')) AS name,
  length(url) > 3 AND upper(right(url, 3)) IN ('ZIP', 'TAR', '.GZ', '.7Z', 'RAR') AS archive,
  upper(right(url || '.zip', 3)) = 'ZIP' AND page_id % 2 = 0 AS archive_zip FROM pages""".replace("\\\\", "\\"))
def fn_base_name(spark, sf):
    p = F.replace("url", F.lit("/"), F.lit("\\"))
    return table(spark, sf, "pages").select(
        "page_id", S.base_name(p).alias("name"), S.is_archive(F.col("url"), F.lit(True)).alias("archive"),
        S.is_archive(F.concat("url", F.lit(".zip")), F.col("page_id") % 2 == 0).alias("archive_zip"),
    )


@query("""SELECT doc_id, split_part(split_part(replace(text, '"', ''), ' -', 1), ' /', 1) AS exe,
  'C:\\bin\\' || source || '.exe' AS service FROM documents""".replace("\\\\", "\\"))
def fn_exe_path(spark, sf):
    command = F.concat(F.lit('"C:\\bin\\'), "source", F.lit('.exe" -k '), "lang", F.lit(" /q"))
    return table(spark, sf, "documents").select("doc_id", S.exe_path(F.col("text")).alias("exe"), S.exe_path(command).alias("service"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'C:\\Windows' ELSE '%SystemRoot%' END || '\\' || n_name || '\\%Other%' AS path FROM nation""".replace("\\\\", "\\"))
def fn_expand_env(spark, sf):
    env = F.when(F.col("n_regionkey") == 0, F.create_map(F.lit("SystemRoot"), F.lit("C:\\Windows"))).otherwise(F.create_map().cast("map<string,string>"))
    path = F.concat(F.lit("%SystemRoot%\\"), "n_name", F.lit("\\%Other%"))
    return table(spark, sf, "nation").select("n_nationkey", S.expand_env(path, ["SystemRoot", "Other"], env).alias("path"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber::BIGINT << 32) + l_orderkey AS luid FROM lineitem")
def fn_luid(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.luid(F.col("l_linenumber"), F.col("l_orderkey")).alias("luid"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN user_id::VARCHAR WHEN 'view' THEN CASE WHEN user_id <> 0 THEN 'true' ELSE 'false' END
  WHEN 'purchase' THEN '0x' || lpad(lower(to_hex(user_id)), 8, '0') WHEN 'signup' THEN '0x' || lpad(lower(to_hex(user_id)), 16, '0') ELSE '' END AS shown FROM events""")
def fn_event_text(spark, sf):
    kinds = F.create_map(*(F.lit(x) for x in ("click", "int", "view", "bool", "purchase", "hex32", "signup", "hex64")))
    kind = F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("other"))
    return table(spark, sf, "events").select("event_id", S.event_text(kind, F.col("user_id").cast("string")).alias("shown"))


_VT = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.VT_NAMES.items())


@query(f"SELECT p_partkey, CASE p_size {_VT} ELSE 'Unknown' END AS vt, 'VT_VECTOR | ' || CASE p_size {_VT} ELSE 'Unknown' END AS vector FROM part")
def fn_vt_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.vt_name(F.col("p_size")).alias("vt"), S.vt_name(F.col("p_size") + 0x1000).alias("vector"))


@query("""WITH s AS (SELECT o_orderkey, lpad(upper(to_hex(o_orderkey)), 8, '0') AS serial FROM orders)
SELECT o_orderkey, serial, regexp_replace(serial[1:2], '^0', '') || regexp_replace(serial[3:4], '^0', '') || regexp_replace(serial[5:6], '^0', '') || regexp_replace(serial[7:8], '^0', '') AS unpadded FROM s""")
def fn_serial(spark, sf):
    s = S.serial_normal(F.lower(F.hex("o_orderkey")))
    return table(spark, sf, "orders").select("o_orderkey", s.alias("serial"), S.serial_unpadded(s).alias("unpadded"))


@query("SELECT page_id, url || ' x' AS target FROM pages")
def fn_url_target(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.url_target(F.concat(F.lit("[InternetShortcut]\r\nURL="), "url", F.lit("%20x\r\n"))).alias("target"))
