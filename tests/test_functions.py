"""Scalar functions: fixed cases and encode-decode round trips over random rows."""

import datetime as dt
import random
import urllib.parse
import uuid

import pytest
from pyspark.sql import functions as F

from hostgrain.functions import scalars as S
from hostgrain.functions.sql import SQL_FUNCTIONS, register_functions

UTC = dt.timezone.utc
EPOCH_1601 = dt.datetime(1601, 1, 1, tzinfo=UTC)


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(row) == 1 else tuple(row)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(500):
        when = dt.datetime(1980, 1, 1) + dt.timedelta(microseconds=rng.randrange(100 * 365 * 86400 * 10**6))
        text = "".join(rng.choice("abcXYZ09 +%/\\\"'é日😀\t\n-") for _ in range(rng.randrange(30)))
        data.append((i, when, text, rng.getrandbits(63), rng.getrandbits(32), bytearray(rng.randbytes(16))))
    return spark.createDataFrame(data, "id long, ts timestamp_ntz, s string, n long, m long, b binary").withColumn("t", F.col("ts").cast("timestamp")).cache()


def test_times(spark, rows):
    bad = rows.filter(S.filetime_to_ts(S.ts_to_filetime(F.col("t"))) != F.col("t")).count()
    assert bad == 0
    even = (F.floor(F.unix_seconds("t") / 2) * 2).cast("timestamp")
    assert rows.filter(~S.fat_to_ts(S.ts_to_fat(F.col("t"))).eqNullSafe(even)).count() == 0
    second = F.date_trunc("second", "t")
    assert rows.filter(~S.parse_display_time(S.display_time(F.col("t"))).eqNullSafe(second)).count() == 0
    for r in rows.select("ts", S.ts_to_filetime(F.col("t")).alias("k"), S.display_time(F.col("t")).alias("d")).collect():
        x = r.ts.replace(tzinfo=UTC) - EPOCH_1601
        assert r.k == (x.days * 86400 + x.seconds) * 10**7 + x.microseconds * 10
        assert r.d == f"{r.ts.day}/{r.ts.month}/{r.ts.year} {r.ts.hour}h{r.ts.minute}m{r.ts.second}s"


def test_time_limits(spark):
    null = one(spark, S.filetime_to_ts(F.lit(0)), S.fat_to_ts(F.lit(0)), S.fat_to_ts(F.lit(0xFFFF)), S.parse_display_time(F.lit("")), S.parse_us_date(F.lit("13/45/2020 00:00:00")))
    assert null == (None,) * 5
    assert one(spark, S.display_time(F.lit("1601-01-01 00:00:00").cast("timestamp"))) == ""
    assert one(spark, S.ole_to_ts(F.lit(25569.5)).cast("string"), S.parse_us_date(F.lit("02/03/2001 04:05:06")).cast("string")) == ("1970-01-01 12:00:00", "2001-02-03 04:05:06")
    assert one(spark, S.utc_to_local(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(-120)).cast("string")) == "2024-01-01 02:00:00"


def test_text_round_trips(rows):
    assert rows.filter(S.rot13(S.rot13(F.col("s"))) != F.col("s")).count() == 0
    for r in rows.select("s", S.json_escape(F.col("s")).alias("e"), S.utf16(F.encode("s", "UTF-16LE")).alias("w"), F.encode("s", "UTF-8").alias("u")).collect():
        assert r.w == r.s
        assert r.e == r.s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
    spark = rows.sparkSession
    quoted = [(urllib.parse.quote(r.s, safe="+"), r.s) for r in rows.select("s").collect()]
    df = spark.createDataFrame(quoted, "q string, s string")
    assert df.filter(~S.percent_decode(F.col("q")).eqNullSafe(F.col("s"))).count() == 0


def test_raw_utf16_never_fails(spark):
    cases = [b"", b"a", b"a\0b", "a😀b".encode("utf-16-le"), b"\x00\xd8a\x00", b"\x00\xdca\x00", b"\x00\xd8\x00\xd8\x00\xdc", b"\x8a\x1d\xb0\x0d\x00\xd8"]
    got = [r[0] for r in spark.createDataFrame([(bytearray(c),) for c in cases], "b binary").select(S.utf16(F.col("b"))).collect()]
    assert got == ["", "", "a", "a😀b", "\ufffda", "\ufffda", "\ufffd\U00010000", "\u1d8a\u0db0\ufffd"]
    assert one(spark, S.ansi_z(F.lit(b"caf\xe9 \x80\x00rest"))) == "café €"


def test_numbers_and_guids(rows):
    for r in rows.select("n", "m", "b", S.le_uint(S.le_bytes(F.col("n"), 8), 0, 8).alias("n2"), S.le_uint(S.le_bytes(F.col("m"), 4), 0, 4).alias("m2"), S.le_int(S.le_bytes(F.col("m"), 4), 0, 4).alias("i"), S.guid_text(F.col("b")).alias("g"), S.guid_bytes(S.guid_text(F.col("b"))).alias("b2")).collect():
        assert (r.n2, r.m2) == (r.n, r.m)
        assert r.i == int.from_bytes(r.m.to_bytes(4, "little"), "little", signed=True)
        assert r.g == "{" + str(uuid.UUID(bytes_le=bytes(r.b))).upper() + "}" and r.b2 == r.b


def test_paths_and_labels(spark):
    assert one(spark, S.exe_path(F.lit('"C:\\a b\\x.exe" -k y /z'))) == "C:\\a b\\x.exe"
    assert one(spark, S.is_archive(F.lit("a.zip"), F.lit(True)), S.is_archive(F.lit("zip"), F.lit(True)), S.is_archive(F.lit("a.gz"), F.lit(False))) == (True, False, False)
    env = F.create_map(F.lit("A"), F.lit("x"))
    assert one(spark, S.expand_env(F.lit("%A%\\%B%"), ["A", "B"], env)) == "x\\%B%"
    assert one(spark, S.multi_sz(F.encode(F.lit("one\0two\0\0three\0"), "UTF-16LE"))) == ["one", "two", "three"]
    assert one(spark, S.hex_dump(F.lit(b"\x01\xab")), S.hex_text(F.lit(5)), S.hex_text(F.lit(300))) == ("01 ab", "05", "12c")
    assert one(spark, S.serial_normal(F.lit("a1b2c3d")), S.serial_unpadded(F.lit("0A1B2C0D"))) == ("0A1B2C3D", "A1B2CD")
    assert one(spark, S.flag_names(F.lit(0x80021), S.LINK_FLAGS)) == ["HasLinkTargetIDList", "HasArguments", "EnableTargetMetadata"]
    assert one(spark, S.vt_name(F.lit(31)), S.vt_name(F.lit(0x101F)), S.vt_name(F.lit(999))) == ("VT_LPWSTR", "VT_VECTOR | VT_LPWSTR", "Unknown")
    assert one(spark, S.url_target(F.lit("[InternetShortcut]\nURL=http://x/a%20b"))) == "http://x/a b"
    assert one(spark, S.text_bool(F.lit("x")), S.text_bool(F.lit("true"))) == (None, True)


def test_garbage_numbers_are_null(spark):
    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    assert one(spark, S.filetime_to_ts(low), S.ole_to_ts(F.lit(1e300)), S.ole_to_ts(F.lit(float("nan")))) == (None, None, None)
    assert spark.range(1).select(S.filetime_to_ts(high).isNotNull()).first()[0]
    kinds = [("uint64", str(2**64 - 1)), ("double", "1.5"), ("float", "x"), ("string_array", "a; b"), ("other", "z")]
    assert [one(spark, S.event_text(F.lit(k), F.lit(v))) for k, v in kinds] == [str(2**64 - 1), "1.5", None, "a; b", ""]


def test_sql_names(spark):
    register_functions(spark)
    damaged = spark.sql("SELECT t.* FROM VALUES (X'0400414201'), (X'0400414201000000'), (NULL) AS b(x), LATERAL af_chain_items(x) AS t").collect()
    assert [(r.pos, r.item and bytes(r.item), r.error is None) for r in damaged] == [(0, b"AB", True), (0, b"AB", True), (1, None, False)]
    assert spark.sql("SELECT af_filetime_to_ts(-9223372036854775808)").first()[0] is None
    assert spark.sql("SELECT af_serial_kept(' 1f2ab ')").first()[0] == "1F2AB"
    rows = spark.sql("SELECT pos, path, error FROM af_shimcache_rows(X'04000000' || X'FFFFFFFF')").collect()  # damage shows
    assert len(rows) == 1 and rows[0].path is None and rows[0].error
    assert spark.sql("SELECT af_rot13('Uryyb'), af_luid(1, 2), af_serial('ab'), af_exe_path('a -b')").first()[:] == ("Hello", 2**32 + 2, "000000AB", "a")
    assert spark.sql(f"SELECT CAST(af_fat_to_ts({((4 << 11 | 6 << 5 | 4) << 16) | (21 << 9 | 2 << 5 | 3)}) AS STRING)").first()[0] == "2001-02-03 04:06:08"
    assert len(SQL_FUNCTIONS) == 39


def test_sql_names_agree_with_the_functions(spark):
    register_functions(spark)
    raw = [b"", bytes(range(16)), b"\xff" * 20, "a\0b😀\0\0c".encode("utf-16-le"), b"\x00\xd8a\x00", None]
    b = F.col("b")
    d = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in raw], "b binary")
    pairs = {
        "af_guid(b)": S.guid_text(b), "af_utf16(b)": S.utf16(b), "af_multi_sz(b)": S.multi_sz(b), "af_hex_dump(b)": S.hex_dump(b), "af_md5(b)": S.md5_upper(b),
        "af_le_uint(b, 1, 2)": S.le_uint(b, 1, 2), "af_le_uint(b, 0, 8)": S.le_uint(b, 0, 8), "af_le_int(b, 3, 4)": S.le_int(b, 3, 4), "af_le_int(b, 8, 8)": S.le_int(b, 8, 8),
    }
    for sql, own in pairs.items():
        assert [r[:] for r in d.select(F.expr(sql), own).collect() if r[0] != r[1]] == [], sql
    texts = ['C:\\a "b"\n\tc\r', "x{00021401-0000-0000-C000-000000000046}y", "0A1B2C0D", "[InternetShortcut]\r\nURL=http://x/a%20b+c\r\n", "", "%A%\\%B%", None]
    t, env = F.col("s"), F.create_map(F.lit("A"), F.lit("x"))
    d = spark.createDataFrame([(x,) for x in texts], "s string")
    pairs = {
        "af_json_escape(s)": S.json_escape(t), "af_first_guid(s)": S.first_guid(t), "af_serial_unpadded(s)": S.serial_unpadded(t), "af_base_name(s)": S.base_name(t), "af_url_target(s)": S.url_target(t),
        "af_rewrite_path(s, 'C:', 'D:')": S.rewrite_path(t, F.lit("C:"), F.lit("D:")), "af_expand_env(s, map('A', 'x'))": S.expand_env(t, ["A"], env),
        "af_replace_guid(s, 'N')": F.when(S.first_guid(t).isNull(), t).otherwise(F.replace(t, S.first_guid(t), F.lit("N"))),
    }
    for sql, own in pairs.items():
        assert [r[:] for r in d.select(F.expr(sql), own).collect() if r[0] != r[1]] == [], sql
    n = F.col("id")
    d = spark.range(0, 5000, 7)
    pairs = {
        "af_file_attributes(id)": S.flag_names(n, S.FILE_ATTRIBUTES), "af_link_flags(id)": S.flag_names(n, S.LINK_FLAGS), "af_fs_flags(id)": S.flag_names(n, S.FS_FLAGS), "af_volume_flag(id)": S.masked_name(n, S.VOLUME_MASK, S.VOLUME_FLAGS),
        "af_vt_name(id)": S.vt_name(n), "af_unix_to_filetime(id)": S.unix_to_filetime(n), "af_ole_to_ts(id / 7D)": S.ole_to_ts(n / 7), "af_utc_to_local(af_ole_to_ts(id), 90)": S.utc_to_local(S.ole_to_ts(n), F.lit(90)),
        "af_local_to_utc(af_ole_to_ts(id), 90)": S.local_to_utc(S.ole_to_ts(n), F.lit(90)), "af_bool_text(id % 2 = 0)": S.bool_text(n % 2 == 0),
        **{f"af_event_text('{k}', CAST(id AS STRING))": S.event_text(F.lit(k), n.cast("string")) for k in ("int", "bool", "hex32", "hex64", "uint64", "double", "string", "other")},
    }
    for sql, own in pairs.items():
        assert [r[:] for r in d.select(F.expr(sql), own).collect() if r[0] != r[1]] == [], sql
    assert one(spark, S.flag_names(F.lit(0x86), S.FS_FLAGS), S.masked_name(F.lit(0x2F), S.VOLUME_MASK, S.VOLUME_FLAGS), S.masked_name(F.lit(0x21), S.VOLUME_MASK, S.VOLUME_FLAGS)) == (["IS_FILE", "IS_UNICODE", "HAS_CLSID"], "LOCALDISK", None)
