"""Scalar functions over artefact values, all built from Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FILETIME ticks at the Unix epoch, and the OLE date of the Unix epoch.
EPOCH_TICKS = 116_444_736_000_000_000
OLE_EPOCH_DAYS = 25_569

DISPLAY_FORMAT = "d/M/y H'h'm'm's's'"
US_FORMAT = "MM/dd/yyyy HH:mm:ss"

# File attribute flags of the shell link format.
FILE_ATTRIBUTES = [
    (0x1, "FILE_ATTRIBUTE_READONLY"), (0x2, "FILE_ATTRIBUTE_HIDDEN"), (0x4, "FILE_ATTRIBUTE_SYSTEM"), (0x10, "FILE_ATTRIBUTE_DIRECTORY"),
    (0x20, "FILE_ATTRIBUTE_ARCHIVE"), (0x80, "FILE_ATTRIBUTE_NORMAL"), (0x100, "FILE_ATTRIBUTE_TEMPORARY"), (0x200, "FILE_ATTRIBUTE_SPARSE_FILE"),
    (0x400, "FILE_ATTRIBUTE_REPARSE_POINT"), (0x800, "FILE_ATTRIBUTE_COMPRESSED"), (0x1000, "FILE_ATTRIBUTE_OFFLINE"),
    (0x2000, "FILE_ATTRIBUTE_NOT_CONTENT_INDEXED"), (0x4000, "FILE_ATTRIBUTE_ENCRYPTED"),
]

# Link flags of the shell link format, in the order of their bits from 0x1; None is unused.
LINK_FLAG_NAMES = [
    "HasLinkTargetIDList", "HasLinkInfo", "HasName", "HasRelativePath", "HasWorkingDir", "HasArguments", "HasIconLocation", "IsUnicode",
    "ForceNoLinkInfo", "HasExpString", "RunInSeparateProcess", None, "HasDarwinID", "RunAsUser", "HasExpIcon", "NoPidlAlias", None,
    "RunWithShimLayer", "ForceNoLinkTrack", "EnableTargetMetadata", "DisableLinkPathTracking", "DisableKnownFolderTracking",
    "DisableKnownFolderAlias", "AllowLinkToLink", "UnaliasOnSave", "PreferEnvironmentPath", "KeepLocalIDListForUNCTarget",
]
LINK_FLAGS = [(1 << bit, name) for bit, name in enumerate(LINK_FLAG_NAMES) if name]

# Class flags of file entries, and names of what the masked class of a volume says.
FS_FLAGS = [(0x01, "IS_DIRECTORY"), (0x02, "IS_FILE"), (0x04, "IS_UNICODE"), (0x80, "HAS_CLSID"), (0x08, "UNKNOWN")]
VOLUME_MASK = 0x8F
VOLUME_FLAGS = {0x00: "NONE", 0x0E: "SYSTEMFOLDER", 0x0F: "LOCALDISK"}

# Names of property types.
VT_NAMES = {
    0: "VT_EMPTY", 1: "VT_NULL", 2: "VT_I2", 3: "VT_I4", 4: "VT_R4", 5: "VT_R8", 6: "VT_CY", 7: "VT_DATE", 8: "VT_BSTR", 9: "VT_DISPATCH",
    10: "VT_ERROR", 11: "VT_BOOL", 12: "VT_VARIANT", 13: "VT_UNKNOWN", 14: "VT_DECIMAL", 16: "VT_I1", 17: "VT_UI1", 18: "VT_UI2", 19: "VT_UI4",
    20: "VT_I8", 21: "VT_UI8", 22: "VT_INT", 23: "VT_UINT", 30: "VT_LPSTR", 31: "VT_LPWSTR", 64: "VT_FILETIME", 65: "VT_BLOB", 66: "VT_STREAM",
    71: "VT_CF", 72: "VT_CLSID",
}

ARCHIVE_SUFFIXES = ["ZIP", "TAR", ".GZ", ".7Z", "RAR"]


def filetime_to_ts(ticks: Column) -> Column:
    """100 ns since 1601 to an instant; 0, null and what is out of range give null."""
    return F.when(ticks != 0, F.timestamp_micros(F.floor(F.try_subtract(ticks.cast("long"), F.lit(EPOCH_TICKS)) / F.lit(10).cast("decimal(20,0)")).cast("long")))


def ts_to_filetime(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 10 + EPOCH_TICKS


def unix_to_filetime(seconds: Column) -> Column:
    return seconds * 10_000_000 + EPOCH_TICKS


def fat_to_ts(packed: Column) -> Column:
    """DOS date (low half) and time (high half) to an instant with even seconds; 0 and impossible dates give null."""
    d, t = packed.bitwiseAND(0xFFFF), F.shiftright(packed, 16).bitwiseAND(0xFFFF)
    parts = [
        F.shiftright(d, 9) + 1980, F.shiftright(d, 5).bitwiseAND(15), d.bitwiseAND(31),
        F.shiftright(t, 11), F.shiftright(t, 5).bitwiseAND(63), t.bitwiseAND(31) * 2,
    ]
    return F.when(packed != 0, F.try_make_timestamp(*(p.cast("int") for p in parts)))


def ts_to_fat(ts: Column) -> Column:
    """The inverse of fat_to_ts for instants from 1980 to 2107."""
    d = F.shiftleft(F.year(ts) - 1980, 9) + F.shiftleft(F.month(ts), 5) + F.dayofmonth(ts)
    t = F.shiftleft(F.hour(ts), 11) + F.shiftleft(F.minute(ts), 5) + F.floor(F.second(ts) / 2)
    return t.cast("long") * 65536 + d


def display_time(ts: Column) -> Column:
    """``d/M/yyyy HhMmSs`` without padding; the FILETIME epoch shows as empty text."""
    return F.when(ts == F.lit("1601-01-01 00:00:00").cast("timestamp"), F.lit("")).otherwise(F.date_format(ts, DISPLAY_FORMAT))


def parse_display_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(DISPLAY_FORMAT))


def parse_us_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(US_FORMAT))


def utc_to_local(ts: Column, bias: Column) -> Column:
    """bias: minutes to add to local time to get UTC."""
    return ts - F.make_interval(mins=bias)


def local_to_utc(ts: Column, bias: Column) -> Column:
    return ts + F.make_interval(mins=bias)


def ole_to_ts(days: Column) -> Column:
    """Days since 1899-12-30 to an instant, to the nearest microsecond; out of range, null."""
    return F.timestamp_micros(F.round((days - OLE_EPOCH_DAYS) * F.lit(86_400_000_000.0)).try_cast("long"))


def rot13(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")


def percent_decode(text: Column) -> Column:
    """``%XX`` in either case; a plus sign stays, and malformed text gives null."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def json_escape(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def hex_text(n: Column) -> Column:
    """Lower-case hexadecimal of at least two digits."""
    h = F.lower(F.hex(n))
    return F.when(F.length(h) < 2, F.concat(F.lit("0"), h)).otherwise(h)


def hex_dump(data: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "))


def md5_upper(data: Column) -> Column:
    return F.upper(F.md5(data))


def le_uint(data: Column, at: int | Column, size: int) -> Column:
    """Little-endian unsigned number at a byte offset; beyond the end null. Eight bytes read as a signed 64-bit number."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.concat(*(F.hex(F.substring(data, at + i + 1, F.lit(1))) for i in reversed(range(size))))
    whole = F.octet_length(data) >= at + size
    if size < 8:
        return F.when(whole, F.conv(digits, 16, 10).cast("long"))
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.when(whole, F.shiftleft(high, 32).bitwiseOR(low))


def le_int(data: Column, at: int | Column, size: int) -> Column:
    """As le_uint, but in two's complement."""
    u = le_uint(data, at, size)
    return u if size == 8 else F.when(u >= 1 << (8 * size - 1), u - (1 << (8 * size))).otherwise(u)


def le_bytes(n: Column, size: int) -> Column:
    """The inverse of le_uint."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def guid_text(data: Column, at: int = 0) -> Column:
    """Sixteen bytes as ``{8-4-4-4-12}``, the first three groups little-endian, in upper case."""
    h = F.hex(F.substring(data, at + 1, 16))
    groups = [(7, 5, 3, 1), (11, 9), (15, 13), (17, 19), (21, 23, 25, 27, 29, 31)]
    text = F.concat_ws("-", *(F.concat(*(F.substring(h, i, 2) for i in g)) for g in groups))
    return F.when(F.length(h) == 32, F.concat(F.lit("{"), text, F.lit("}")))


def guid_bytes(text: Column) -> Column:
    """The inverse of guid_text."""
    h = F.regexp_replace(text, "[{}-]", "")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1, 11, 9, 15, 13)), F.substring(h, 17, 16)))


GUID_PATTERN = r"\{[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}"


def first_guid(text: Column) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(GUID_PATTERN), F.lit(0)), F.lit(0))


def flag_names(value: Column, flags: list[tuple[int, str]]) -> Column:
    """Names of the bits that are set, in the order of flags."""
    return F.array_compact(F.array(*(F.when(value.bitwiseAND(mask) != 0, F.lit(name)) for mask, name in flags)))


def masked_name(value: Column, mask: int, names: dict[int, str]) -> Column:
    """The one name of the masked value; null without any."""
    out = F.lit(None).cast("string")
    for k, name in names.items():
        out = F.when(value.bitwiseAND(mask) == k, F.lit(name)).otherwise(out)
    return out


#: A surrogate without its other half, in code units written as four digits and a space each.
_LONE_SURROGATE = r"\bD[89AB]..(?! D[C-F]..)|(?<!D[89AB].. )\bD[C-F].."


def utf16(data: Column) -> Column:
    """UTF-16LE text. An odd last byte is left out, and a lone surrogate becomes U+FFFD: raw bytes never fail."""
    even = F.substring(data, F.lit(1), F.octet_length(data) - F.octet_length(data) % 2)
    units = F.regexp_replace(F.hex(even), "(..)(..)", "$2$1 ")
    mended = F.unhex(F.regexp_replace(F.regexp_replace(units, _LONE_SURROGATE, "FFFD"), "(..)(..) ", "$2$1"))
    return F.decode(F.when(F.regexp_like(units, F.lit(_LONE_SURROGATE)), mended).otherwise(even), "UTF-16LE")


def utf16_z(data: Column) -> Column:
    """UTF-16LE up to its first NUL."""
    return F.substring_index(utf16(data), "\0", 1)


# What code page 1252 has in the place of ISO 8859-1's control characters.
CP1252_CODES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def ansi_z(data: Column) -> Column:
    """Code page 1252 up to its first NUL."""
    return F.substring_index(F.translate(F.decode(data, "ISO-8859-1"), CP1252_CODES, CP1252_CHARS), "\0", 1)


def multi_sz(data: Column) -> Column:
    """NUL-separated UTF-16LE texts; empty ones are dropped."""
    return F.filter(F.split(utf16(data), "\0"), lambda s: s != "")


def bool_text(value: Column) -> Column:
    return F.when(value, "true").otherwise("false")


def text_bool(text: Column) -> Column:
    return text.try_cast("boolean")


def rewrite_path(path: Column, old: Column, new: Column) -> Column:
    return F.replace(path, old, new)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"\\"), -1)


def is_archive(name: Column, is_file: Column) -> Column:
    return is_file & (F.length(name) > 3) & F.upper(F.right(name, F.lit(3))).isin(ARCHIVE_SUFFIXES)


def exe_path(command: Column) -> Column:
    """A command line without quotes, cut at the first `` -`` and then the first `` /``."""
    return F.substring_index(F.substring_index(F.replace(command, F.lit('"'), F.lit("")), " -", 1), " /", 1)


def expand_env(text: Column, names: list[str], env: Column) -> Column:
    """``%NAME%`` replaced by env[NAME]; unknown names stay."""
    for n in names:
        marker = f"%{n}%"
        text = F.replace(text, F.lit(marker), F.coalesce(F.element_at(env, F.lit(n)), F.lit(marker)))
    return text


def luid(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32) + low.cast("long")


def event_text(kind: Column, value: Column) -> Column:
    """Text of an event's value by its kind; unknown kinds show as empty text. uint64 covers all 64 bits; an array of
    strings is given as its joined text."""
    number = value.try_cast("long")
    return (
        F.when(kind.isin("int", "uint"), number.cast("string"))
        .when(kind == "bool", bool_text(number != 0))
        .when(kind == "hex32", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 8, "0")))
        .when(kind == "hex64", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 16, "0")))
        .when(kind == "uint64", value.try_cast("decimal(20,0)").cast("string"))
        .when(kind.isin("float", "double"), value.try_cast("double").cast("string"))
        .when(kind.isin("string", "guid", "sid", "string_array"), value)
        .otherwise("")
    )


def vt_name(code: Column) -> Column:
    """Name of a property type; the vector flag shows as a prefix."""
    pairs = [x for k, v in VT_NAMES.items() for x in (F.lit(k), F.lit(v))]
    name = F.coalesce(F.element_at(F.create_map(*pairs), code.bitwiseAND(0xFFF).cast("int")), F.lit("Unknown"))
    return F.when(code.bitwiseAND(0x1000) != 0, F.concat(F.lit("VT_VECTOR | "), name)).otherwise(name)


def serial_text(serial: Column) -> Column:
    """A volume serial, a number, as eight upper-case digits."""
    return F.lpad(F.upper(F.hex(serial)), 8, "0")


def serial_normal(text: Column) -> Column:
    return F.upper(F.lpad(text, 8, "0"))


def serial_kept(text: Column) -> Column:
    """A serial's text as it was collected, in upper case. A shorter text than eight digits may have lost the leading
    zero of any byte, so it isn't filled up: lookups compare it with that spelling of known serials."""
    return F.upper(F.trim(text))


def serial_unpadded(text: Column) -> Column:
    """The spelling that lost the leading zero of each byte, in upper case, of a normal serial."""
    return F.concat(*(F.regexp_replace(F.substring(text, 1 + 2 * i, 2), "^0", "") for i in range(4)))


def url_target(body: Column) -> Column:
    """Target of an internet shortcut: its second line after ``URL=``, percent-decoded."""
    line = F.rtrim(F.regexp_replace(F.get(F.split(body, "\n"), F.lit(1)), "\r", ""))
    return percent_decode(F.substring(line, F.lit(5), F.length(line)))
