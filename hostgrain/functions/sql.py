"""The scalar functions under SQL names, and table functions over blobs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import scalars as S


def _text(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _flags(flags: list[tuple[int, str]]) -> str:
    """Names of the bits of v that are set."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN v & {mask} <> 0 THEN {_text(name)} END" for mask, name in flags) + "))"


def _labels(labels: dict[int, str], code: str) -> str:
    return "element_at(map(" + ", ".join(f"{k}, {_text(v)}" for k, v in labels.items()) + f"), CAST({code} AS INT))"


#: Two digits each of a GUID's text, by where its bytes stand.
_GUID = "concat('{', " + ", '-', ".join("concat(" + ", ".join(f"substring(hex(b), {2 * i + 1}, 2)" for i in g) + ")" for g in [(3, 2, 1, 0), (5, 4), (7, 6), (8, 9), (10, 11, 12, 13, 14, 15)]) + ", '}')"
_EVEN = "substring(b, 1, octet_length(b) - octet_length(b) % 2)"
_UNITS = f"regexp_replace(hex({_EVEN}), '(..)(..)', '$2$1 ')"
_LONE = _text(S._LONE_SURROGATE)
_FIRST_GUID = f"get(regexp_extract_all(s, {_text(S.GUID_PATTERN)}, 0), 0)"

#: Name to parameters, result and body.
SQL_FUNCTIONS = {
    "af_filetime_to_ts": ("t BIGINT", "TIMESTAMP", "CASE WHEN t <> 0 THEN timestamp_micros(try_subtract(t, 116444736000000000) div 10) END"),
    "af_ts_to_filetime": ("ts TIMESTAMP", "BIGINT", "unix_micros(ts) * 10 + 116444736000000000"),
    "af_fat_to_ts": ("v BIGINT", "TIMESTAMP", """CASE WHEN v <> 0 THEN try_make_timestamp(CAST(1980 + (shiftright(v, 9) & 127) AS INT), CAST(shiftright(v, 5) & 15 AS INT), CAST(v & 31 AS INT),
        CAST(shiftright(v, 27) & 31 AS INT), CAST(shiftright(v, 21) & 63 AS INT), CAST((shiftright(v, 16) & 31) * 2 AS DECIMAL(8, 6))) END"""),
    "af_display_time": ("ts TIMESTAMP", "STRING", "CASE WHEN ts = TIMESTAMP'1601-01-01 00:00:00' THEN '' ELSE date_format(ts, \"d/M/y H'h'm'm's's'\") END"),
    "af_parse_display_time": ("s STRING", "TIMESTAMP", "try_to_timestamp(s, \"d/M/y H'h'm'm's's'\")"),
    "af_parse_us_date": ("s STRING", "TIMESTAMP", "try_to_timestamp(s, 'MM/dd/yyyy HH:mm:ss')"),
    "af_rot13": ("s STRING", "STRING", "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"),
    "af_percent_decode": ("s STRING", "STRING", "try_url_decode(replace(s, '+', '%2B'))"),
    "af_hex_text": ("n BIGINT", "STRING", "CASE WHEN length(hex(n)) < 2 THEN concat('0', lower(hex(n))) ELSE lower(hex(n)) END"),
    "af_exe_path": ("s STRING", "STRING", "substring_index(substring_index(replace(s, '\"', ''), ' -', 1), ' /', 1)"),
    "af_luid": ("hi BIGINT, lo BIGINT", "BIGINT", "shiftleft(hi, 32) + lo"),
    "af_serial": ("s STRING", "STRING", "upper(lpad(s, 8, '0'))"),
    "af_serial_kept": ("s STRING", "STRING", "upper(trim(s))"),
    "af_serial_unpadded": ("s STRING", "STRING", "concat(" + ", ".join(f"regexp_replace(substring(s, {2 * i + 1}, 2), '^0', '')" for i in range(4)) + ")"),
    "af_unix_to_filetime": ("s BIGINT", "BIGINT", "s * 10000000 + 116444736000000000"),
    "af_utc_to_local": ("ts TIMESTAMP, bias INT", "TIMESTAMP", "ts - make_interval(0, 0, 0, 0, 0, bias, 0)"),
    "af_local_to_utc": ("ts TIMESTAMP, bias INT", "TIMESTAMP", "ts + make_interval(0, 0, 0, 0, 0, bias, 0)"),
    "af_ole_to_ts": ("d DOUBLE", "TIMESTAMP", "timestamp_micros(try_cast(round((d - 25569) * 86400000000D) AS BIGINT))"),
    "af_json_escape": ("s STRING", "STRING", r"""replace(replace(replace(replace(replace(s, '\\', '\\\\'), '"', '\\"'), '\r', '\\r'), '\n', '\\n'), '\t', '\\t')"""),
    "af_hex_dump": ("b BINARY", "STRING", "rtrim(regexp_replace(lower(hex(b)), '(..)', '$1 '))"),
    "af_md5": ("b BINARY", "STRING", "upper(md5(b))"),
    "af_guid": ("b BINARY", "STRING", f"CASE WHEN octet_length(b) >= 16 THEN {_GUID} END"),
    "af_first_guid": ("s STRING", "STRING", _FIRST_GUID),
    "af_replace_guid": ("s STRING, name STRING", "STRING", f"CASE WHEN name <> '' THEN coalesce(replace(s, {_FIRST_GUID}, name), s) ELSE s END"),
    "af_file_attributes": ("v BIGINT", "ARRAY<STRING>", _flags(S.FILE_ATTRIBUTES)),
    "af_link_flags": ("v BIGINT", "ARRAY<STRING>", _flags(S.LINK_FLAGS)),
    "af_fs_flags": ("v BIGINT", "ARRAY<STRING>", _flags(S.FS_FLAGS)),
    "af_volume_flag": ("v BIGINT", "STRING", _labels(S.VOLUME_FLAGS, f"v & {S.VOLUME_MASK}")),
    "af_utf16": ("b BINARY", "STRING", f"decode(CASE WHEN regexp_like({_UNITS}, {_LONE}) THEN unhex(regexp_replace(regexp_replace({_UNITS}, {_LONE}, 'FFFD'), '(..)(..) ', '$2$1')) ELSE {_EVEN} END, 'UTF-16LE')"),
    "af_multi_sz": ("b BINARY", "ARRAY<STRING>", r"array_remove(split(af_utf16(b), '\0'), '')"),
    "af_le_uint": ("b BINARY, at INT, n INT", "BIGINT", "CASE WHEN at >= 0 AND n BETWEEN 1 AND 8 AND octet_length(b) >= at + n THEN CAST(conv(array_join(reverse(regexp_extract_all(hex(substring(b, at + 1, n)), '..', 0)), ''), 16, -10) AS BIGINT) END"),
    "af_le_int": ("b BINARY, at INT, n INT", "BIGINT", "CASE WHEN n < 8 AND af_le_uint(b, at, n) >= shiftleft(1L, 8 * n - 1) THEN af_le_uint(b, at, n) - shiftleft(1L, 8 * n) ELSE af_le_uint(b, at, n) END"),
    "af_bool_text": ("v BOOLEAN", "STRING", "CASE WHEN v THEN 'true' ELSE 'false' END"),
    "af_rewrite_path": ("p STRING, old STRING, new STRING", "STRING", "replace(p, old, new)"),
    "af_base_name": ("p STRING", "STRING", r"element_at(split(p, '\\\\'), -1)"),
    "af_expand_env": ("s STRING, env MAP<STRING, STRING>", "STRING", "aggregate(map_entries(env), s, (a, e) -> replace(a, concat('%', e.key, '%'), coalesce(e.value, concat('%', e.key, '%'))))"),
    "af_event_text": ("kind STRING, v STRING", "STRING", """CASE WHEN kind IN ('int', 'uint') THEN CAST(try_cast(v AS BIGINT) AS STRING)
        WHEN kind = 'bool' THEN CASE WHEN try_cast(v AS BIGINT) <> 0 THEN 'true' ELSE 'false' END
        WHEN kind = 'hex32' THEN concat('0x', lpad(lower(hex(try_cast(v AS BIGINT))), 8, '0')) WHEN kind = 'hex64' THEN concat('0x', lpad(lower(hex(try_cast(v AS BIGINT))), 16, '0'))
        WHEN kind = 'uint64' THEN CAST(try_cast(v AS DECIMAL(20, 0)) AS STRING) WHEN kind IN ('float', 'double') THEN CAST(try_cast(v AS DOUBLE) AS STRING)
        WHEN kind IN ('string', 'guid', 'sid', 'string_array') THEN v ELSE '' END"""),
    "af_vt_name": ("v BIGINT", "STRING", f"concat(CASE WHEN v & 4096 <> 0 THEN 'VT_VECTOR | ' ELSE '' END, coalesce({_labels(S.VT_NAMES, 'v & 4095')}, 'Unknown'))"),
    "af_url_target": ("s STRING", "STRING", r"try_url_decode(replace(substring(rtrim(replace(get(split(s, '\n'), 1), '\r', '')), 5), '+', '%2B'))"),
}


@udtf(returnType="pos: int, item: binary, error: string", useArrow=True)
class ChainItems:
    """Items of a chain with 16-bit sizes; where it is damaged, a last row with the error."""

    def eval(self, blob: bytes):
        from hostgrain.operators.decode import chain_items

        pos = 0
        try:
            for item in chain_items(blob or b""):
                yield pos, item, None
                pos += 1
        except ValueError as e:
            yield pos, None, str(e)


@udtf(returnType="pos: int, path: string, ticks: bigint, executed: boolean, error: string", useArrow=True)
class ShimcacheRows:
    """Records of a shimcache blob; where it is damaged, a last row with the error."""

    def eval(self, blob: bytes):
        from hostgrain.operators.decode import parse_shimcache

        pos = 0
        try:
            for r in parse_shimcache(blob or b""):
                yield pos, r["path"], r["ticks"], r["executed"], None
                pos += 1
        except ValueError as e:
            yield pos, None, None, None, str(e)


def register_functions(spark: SparkSession) -> None:
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("af_chain_items", ChainItems)
    spark.udtf.register("af_shimcache_rows", ShimcacheRows)
