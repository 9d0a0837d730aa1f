"""Binary decoders on hand-packed bytes; damaged bytes are set apart and never raise."""

import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from hostgrain.operators import decode as B
from hostgrain.operators import lookups as L
from hostgrain.operators import tables as T

T1 = 133_000_000_000_000_000


def wide(s):
    return s.encode("utf-16-le")


def fat(y, mo, d, h, mi, s):
    return struct.pack("<HH", (y - 1980) << 9 | mo << 5 | d, h << 11 | mi << 5 | s // 2)


def file_entry(name, long, kind=0x32, size=5):
    short = name.encode() + b"\0"
    short += b"\0" * (len(short) % 2)
    first = 14 + len(short)
    text = wide(long) + b"\0\0"
    block = struct.pack("<HHI", 22 + len(text), 3, 0xBEEF0004) + fat(2001, 2, 3, 4, 6, 8) + fat(2002, 2, 3, 4, 6, 8) + struct.pack("<HH", 20, 0) + text + struct.pack("<H", first)
    body = bytes([kind, 0]) + struct.pack("<I", size) + fat(2000, 1, 1, 0, 0, 0) + struct.pack("<H", 0x20) + short + block
    return struct.pack("<H", len(body) + 2) + body


ITEMS = struct.pack("<H", 7) + b"\x2fC:\\\0" + file_entry("A.ZIP", "archive long.zip") + file_entry("DIR", "folder", 0x31) + b"\0\0"


def lnk(network=False):
    strings = b"".join(struct.pack("<H", len(s)) + wide(s) for s in ("description", ".\\rel", "C:\\work", "-a -b", "icon.ico"))
    header = B.LNK_HEADER + struct.pack("<IIQQQIiIHHII", 0xFF, 0x21, T1, T1 + 10**7, T1 + 2 * 10**7, 9, -3, 1, 0, 0, 0, 0)
    if network:
        net = struct.pack("<IIIIII", 0, 3, 20, 20 + 11, 0x20000, 0)[:20] + b"\\\\srv\\data\0" + b"Z:\0"
        info = struct.pack("<IIIIIII", 28 + len(net), 28, 2, 0, 0, 28, 0) + net
    else:
        volume = struct.pack("<IIII", 16 + 5, 3, 0x0A1B2C3D, 16) + b"DISK\0"
        path = b"C:\\x.txt\0"
        info = struct.pack("<IIIIIII", 28 + len(volume) + len(path) + 1, 28, 1, 28, 28 + len(volume), 0, 28 + len(volume) + len(path)) + volume + path + b"\0"
    return header + struct.pack("<H", len(ITEMS)) + ITEMS + info + strings


def prefetch(version=30, flag=0):
    files = ["\\VOLUME{1}\\A\\X.EXE", "\\VOLUME{2}\\B\\Y.DLL", "\\VOLUME{1}\\C\\X.EXE"]
    names = "".join(f + "\0" for f in files).encode("utf-16-le")
    body = bytearray(304)
    struct.pack_into("<I4s", body, 0, version, b"SCCA")
    body[16:16 + 10] = wide("X.EXE")
    struct.pack_into("<I", body, 76, 0x0A1B2C3D)
    at = 304
    struct.pack_into("<IIII", body, 84 + 16, at, len(names), at + len(names), 2)
    struct.pack_into("<8Q", body, 84 + 44, T1, T1 + 10**7, T1 + 2 * 10**7, 0, 0, 0, 0, 0)
    struct.pack_into("<III", body, 84 + 116, 11, flag, 22)
    volumes = b""
    devices = [wide("\\VOLUME{1}"), wide("\\VOLUME{2}")]
    tail = b""
    for d, serial in zip(devices, (0x0A1B2C3D, 0x00000001)):
        name_at = 192 + len(tail)
        tail += d + b"\0\0"
        dir_at = 192 + len(tail)
        tail += struct.pack("<H", 2) + wide("\\D") + b"\0\0"
        volumes += struct.pack("<IIQIIIIIII", name_at, len(d) // 2, T1, serial, 0, 0, dir_at, 1, 0, 0).ljust(96, b"\0")
    return bytes(body) + names + volumes + tail


def shimcache():
    def record(path, ticks, data):
        return b"10ts" + bytes(8) + struct.pack("<H", 2 * len(path)) + wide(path) + struct.pack("<QI", ticks, len(data)) + data

    return struct.pack("<I", 52) + bytes(48) + record("C:\\a\tb.exe", T1, b"") + record("C:\\c.exe", T1, bytes(4) + struct.pack("<I", 1)) + record("C:\\d.exe", 0, bytes(8)) + b"zzzz" + bytes(40)


def destlist():
    def entry(no, pin, path):
        return bytes(8) + bytes(range(64)) + b"HOST".ljust(16, b"\0") + struct.pack("<I", no) + bytes(8) + struct.pack("<Qi", T1, pin) + bytes(16) + struct.pack("<H", len(path)) + wide(path) + bytes(4)

    return struct.pack("<III", 4, 3, 1) + bytes(20) + entry(1, -1, "C:\\one") + entry(26, 0, "C:\\two") + entry(3, -1, "C:\\three")


def frame(spark, *blobs):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "id int, b binary")


def test_lnk(spark):
    good, bad = B.split_errors(B.decode_lnk(frame(spark, lnk(), lnk(True), b"x" * 100, lnk()[:60]), "b", ["id"]))
    a, n = sorted(good.collect())
    assert (a.link_flags, a.attributes, a.icon_index, a.show_code, a.drive_code, a.vol_serial, a.vol_label, a.base_path) == (0xFF, 0x21, -3, 1, 3, "0A1B2C3D", "DISK", "C:\\x.txt")
    assert (a.descr, a.rel_path, a.work_dir, a.args, a.icon_location) == ("description", ".\\rel", "C:\\work", "-a -b", "icon.ico")
    assert (a.created_ticks, a.accessed_ticks, a.modified_ticks) == (T1, T1 + 10**7, T1 + 2 * 10**7)
    assert (n.net_name, n.net_device, n.net_code) == ("\\\\srv\\data", "Z:", 0x20000)
    assert sorted(r.id for r in bad.collect()) == [2, 3]
    items = B.decode_shell_items(good.filter("id = 0"), "idlist", ["id"]).orderBy("pos").collect()
    assert [(r.type, r.name) for r in items] == [("Volume", "C:\\"), ("FileEntry", "A.ZIP"), ("FileEntry", "DIR")]
    assert items[1].blocks[0].text == "archive long.zip" and items[1].blocks[0].signature == "beef0004"


def test_prefetch(spark):
    good, bad = B.split_errors(B.decode_prefetch(frame(spark, prefetch(), prefetch(flag=1), prefetch(26), b"MAM\x04junk"), "b", ["id"]))
    a, b = sorted(good.collect())
    assert (a.name, a.hash, a.run_count, b.run_count, len(a.runs)) == ("X.EXE", "0A1B2C3D", 22, 11, 3)
    assert [(v.device, v.serial, v.dirs) for v in a.volumes] == [("\\VOLUME{1}", "0A1B2C3D", ["\\D"]), ("\\VOLUME{2}", "00000001", ["\\D"])]
    letters = F.create_map(F.lit("0A1B2C3D"), F.lit("C:"))
    t = T.prefetch_from_files(good.filter("id = 0"), letters).first()
    assert t.full_path == "C:\\C\\X.EXE" and t.paths[1].path == "\\VOLUME{2}\\B\\Y.DLL"
    assert {r.id: r.error.split()[0] for r in B.decode_prefetch(frame(spark, prefetch(26)), "b", ["id"]).collect()} == {0: "version"} and bad.count() == 2


def test_numbers_of_32_bits_and_values_that_fit_no_column(spark):
    """Damaged numbers are values or quarantined rows; the good rows of the same batch stay."""
    big = bytearray(lnk())
    big[60:64] = b"\xff\xff\xff\xff"  # show command
    at = bytes(big).index(struct.pack("<II", 3, 0x0A1B2C3D))
    big[at:at + 4] = b"\xfe\xff\xff\xff"  # drive type
    good, bad = B.split_errors(B.decode_lnk(frame(spark, bytes(big), lnk()), "b", ["id"]))
    assert sorted((r.id, r.show_code, r.drive_code) for r in good.collect()) == [(0, 2**32 - 1, 2**32 - 2), (1, 1, 3)] and bad.count() == 0
    pf = bytearray(prefetch())
    pf[0:4] = b"\xff\xff\xff\xff"
    assert {r.id: r.version for r in B.split_errors(B.decode_prefetch(frame(spark, bytes(pf), prefetch()), "b", ["id"]))[0].collect()} == {0: 2**32 - 1, 1: 30}
    odd = lambda d: iter([{"n": 1}, {"n": 2**40 if d == b"x" else 2}, {"n": "text" if d == b"y" else 3}])
    rows = B.decode(frame(spark, b"x", b"y", b"z"), "b", ["id"], "n int", odd).collect()
    assert sorted((r.id, r.pos, r.n) for r in rows if r.error is None) == [(0, 0, 1), (0, 2, 3), (1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2), (2, 2, 3)]
    assert sorted((r.id, r.pos) for r in rows if r.error) == [(0, 1), (1, 2)]


def test_shimcache(spark):
    good, bad = B.split_errors(B.decode_shimcache(frame(spark, shimcache()), "b", ["id"]))
    assert [(r.pos, r.path, r.executed) for r in good.orderBy("pos").collect()] == [(0, "C:\\a b.exe", False), (1, "C:\\c.exe", True), (2, "C:\\d.exe", False)]
    assert bad.count() == 1


def test_destlist_and_streams(spark):
    good, _ = B.split_errors(B.decode_destlist(frame(spark, destlist()), "b", ["id"]))
    rows = good.orderBy("pos").collect()
    assert [(r.entry_no, r.host, r.path, r.pinned) for r in rows] == [(1, "HOST", "C:\\one", False), (26, "HOST", "C:\\two", True), (3, "HOST", "C:\\three", False)]
    assert rows[0].birth_volume != rows[0].birth_file
    streams = spark.createDataFrame([(0, "1"), (0, "3")], "id int, stream string")
    assert sorted(r.entry_no for r in L.entry_streams(good, streams, ["id"]).collect()) == [1, 3]
    assert [r.entry_no for r in L.entry_streams(good, streams, ["id"], stop_at_gap="pos").collect()] == [1]


def test_custom_destinations(spark):
    good, _ = B.split_errors(B.embedded_links(frame(spark, b"head" + lnk() + b"between" + lnk(True), b"nothing"), "b", ["id"]))
    assert [(r.id, r.offset) for r in good.orderBy("offset").collect()] == [(0, 4), (0, 4 + len(lnk()) + 7)]
    assert [r.offset for r in B.find_signature(frame(spark, b"aaa"), "b", ["id"], b"aa").collect()] == [0, 1]


def test_properties(spark):
    def value(body):
        return struct.pack("<I", len(body) + 4) + body

    def numbered(id, vt, data):
        return value(struct.pack("<IBHH", id, 0, vt, 0) + data)

    def store(guid, *values):
        return value(b"1SPS" + guid + b"".join(values) + bytes(4))

    key = wide("Key\0")
    named = value(struct.pack("<IB", len(key), 0) + key + struct.pack("<HHI", 31, 0, 2) + wide("v\0"))
    numbers = numbered(2, 3, struct.pack("<i", -5)), numbered(3, 11, struct.pack("<H", 0xFFFF)), numbered(4, 65, b"\x01\x02")
    blob = store(bytes(range(16)), *numbers) + store(uuid.UUID(B.NAMED_PROPERTIES).bytes_le, named) + bytes(4)
    rows = B.decode_properties(frame(spark, blob), "b", ["id"]).orderBy("pos").collect()
    assert [(r.name, r.vt, r.value, r.error) for r in rows] == [(None, 3, "-5", None), (None, 11, "true", None), (None, 65, "0102", None), ("Key", 31, "v", None)]


@pytest.mark.parametrize("parse, whole", [(B.parse_lnk, lnk()), (B.parse_lnk, lnk(True)), (B.parse_prefetch, prefetch()), (B.parse_shimcache, shimcache()), (B.parse_destlist, destlist()), (B.parse_shell_items, ITEMS)])
def test_damage_never_raises_anything_else(parse, whole):
    rng = random.Random(1)
    for n in range(0, len(whole), 3):
        try:
            list(parse(whole[:n]))
        except (ValueError, IndexError, struct.error):
            pass
    for _ in range(500):
        b = bytearray(whole)
        for _ in range(4):
            b[rng.randrange(len(b))] = rng.randrange(256)
        try:
            list(parse(bytes(b)))
        except (ValueError, IndexError, struct.error, OverflowError):
            pass


def test_null_and_empty_blobs(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b""))], "id int, b binary")
    assert [(r.id, r.error is not None) for r in B.decode_lnk(df, "b", ["id"]).collect()] == [(2, True)]
    assert B.walk_chain(df, "b", ["id"]).count() == 0
