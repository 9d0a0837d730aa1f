"""From raw values and files to tables: order, gaps, damage, and what blocks and values hold."""

import json
import struct
import uuid

from pyspark.sql import functions as F

from hostgrain.operators import decode as B
from hostgrain.operators import nested as N
from hostgrain.operators import raw_tables as R
from hostgrain.sources import artefacts as A

from .test_decode import ITEMS, destlist, file_entry, frame, lnk, wide

USERS = "host string, sid string, name string"
APPS = "app_id string, name string"


def order(*numbers):
    return struct.pack(f"<{len(numbers)}I", *numbers)


def registry(spark, rows):
    return spark.createDataFrame([("h", "nt", "S-1", k, n, "REG_BINARY", bytearray(d) if d is not None else None, None) for k, n, d in rows], A.REG_VALUES)


def test_recent_lists(spark):
    key = "Software\\ComDlg32\\OpenSavePidlMRU"
    inside = struct.pack("<H", 50) + b"\x52\0" + bytes(46)
    rows = [
        (key + "\\txt", "MRUListEx", order(2, 0, 7, 0xFFFFFFFF, 1)), (key + "\\txt", "0", ITEMS), (key + "\\txt", "1", ITEMS), (key + "\\txt", "2", file_entry("X.ZIP", "x.zip") + inside + b"\0\0"),
        (key + "\\*", "MRUListEx", order(0)), (key + "\\*", "0", ITEMS), (key + "\\bad", "MRUListEx", order(1, 0) + b"\1"), (key + "\\bad", "0", file_entry("A", "a") + b"\xff\x00zz"), (key + "\\bad", "1", None),
        (key + "\\none", "MRUListEx", b"\1"), ("Software\\ComDlg32\\LastVisitedPidlMRU", "MRUListEx", order(5)), ("Software\\ComDlg32\\LastVisitedPidlMRU", "5", wide("a😀.exe\0") + ITEMS),
    ]
    reg = registry(spark, rows)
    users = spark.createDataFrame([("h", "S-1", "ann")], USERS)
    got = {(r.extension, r.rank): r for r in R.mru_from_registry(reg, users).collect()}
    assert set(got) == {("txt", 0), ("txt", 1), ("bad", 1)}
    assert [(r.id, r.sid_name, r.source, [i["name"] for i in r["items"]]) for r in (got["txt", 0], got["txt", 1])] == [(2, "ann", "OpenSavePidlMRU", ["X.ZIP", ""]), (0, "ann", "OpenSavePidlMRU", ["C:\\", "A.ZIP", ""])]
    assert [(i.type, i.in_archive) for i in got["txt", 0]["items"]] == [("FileEntry", False), ("ArchiveContent", True)]
    assert [i.type for i in got["bad", 1]["items"]] == ["FileEntry"] and got["bad", 1].error
    app = R.mru_apps_from_registry(reg, users).collect()
    assert [(r.name, r.source, len(r["items"]), r.error) for r in app] == [("a😀.exe", "LastVisitedPidlMRU", 3, None)]
    assert R.mru_from_registry(reg.limit(0), users).count() == 0 and R.mru_apps_from_registry(reg.limit(0), users.limit(0)).count() == 0


def test_shortcut_files(spark):
    ddl = "path string, host string, owner string, content binary"
    lnks = spark.createDataFrame([("a.lnk", "h", "u", bytearray(lnk())), ("n.lnk", "h", "u", bytearray(lnk(True))), ("x.lnk", "h", "u", bytearray(b"zz")), ("0.lnk", "h", "u", None)], ddl)
    urls = spark.createDataFrame([("a.url", "h", "u", bytearray(b"[InternetShortcut]\r\nURL=http://x/a%20b\r\n")), ("b.url", "h", "u", bytearray(b"one line"))], ddl)
    out, bad = R.recent_docs_from_files(lnks, urls)
    got = {r.path: r for r in out.collect()}
    assert set(got) == {"a.lnk", "n.lnk", "a.url"} and sorted(r.path for r in bad.collect()) == ["b.url", "x.lnk"]
    a, n = got["a.lnk"], got["n.lnk"]
    assert (a.target, a.drive_type, a.vol_serial, a.show_cmd, a.net_provider, a.flags[0], a.attrs[0]) == ("C:\\x.txt", "DRIVE_FIXED", "0A1B2C3D", "SW_SHOWNORMAL", None, "HasLinkTargetIDList", "FILE_ATTRIBUTE_READONLY")
    assert (n.target, n.net_device, n.net_provider, n.drive_type) == ("\\\\srv\\data", "Z:", "BAD NET PROVIDER", None)
    assert got["a.url"].target == "http://x/a b" and got["a.url"].flags is None


def test_jump_lists(spark):
    apps = spark.createDataFrame([("ab1", "Editor"), ("AB1", "Editor")], APPS)
    lists = spark.createDataFrame([("h", "C:\\u\\AB1.automaticDestinations-ms", bytearray(destlist())), ("h", "C:\\u\\zz.automaticDestinations-ms", bytearray(b"short"))], "host string, file string, content binary")
    file = "C:\\u\\AB1.automaticDestinations-ms"
    streams = spark.createDataFrame([("h", file, "1", bytearray(lnk())), ("h", file, "3", bytearray(lnk(True))), ("h", file, "1F", bytearray(lnk()))], "host string, file string, stream string, content binary")
    out, bad = R.jumplist_auto_from_streams(lists, streams, apps)
    got = sorted(out.collect(), key=lambda r: r.pos)
    assert [(r.entry_no, r.application, r.host_name, r.entry_path, r.pinned, r.target, r.last_mod_ts.year) for r in got] == [(1, "Editor", "HOST", "C:\\one", False, "C:\\x.txt", 2022), (3, "Editor", "HOST", "C:\\three", False, "\\\\srv\\data", 2022)]
    assert [r.file for r in bad.collect()] == ["C:\\u\\zz.automaticDestinations-ms"]
    assert [r.entry_no for r in R.jumplist_auto_from_streams(lists, streams, apps, True)[0].collect()] == [1]
    broken = bytearray(lnk())[:60]
    rows = [("h", "AB1.x", struct.pack("<I", 2) + bytes(20) + lnk() + b"gap" + broken + lnk(True)), ("h", "b", struct.pack("<I", 1) + lnk()), ("h", "c", struct.pack("<I", 9)), ("h", "d", None)]
    files = spark.createDataFrame([(h, f, bytearray(c) if c is not None else None) for h, f, c in rows], "host string, file string, content binary")
    out, bad = R.jumplist_custom_from_files(files, apps)
    got = sorted(((r.file, r.application, r.type, r.target) for r in out.collect()), key=repr)
    assert got == [("AB1.x", "Editor", "User tasks", "C:\\x.txt"), ("AB1.x", "Editor", "User tasks", "\\\\srv\\data"), ("b", "b", "Known category", None), ("c", "c", "", None), ("d", "d", "", None)]
    assert [r.file for r in bad.collect()] == ["AB1.x"]


def value(id, vt, data):
    body = struct.pack("<IBHH", id, 0, vt, 0) + data
    return struct.pack("<I", len(body) + 4) + body


def store(*values):
    body = b"1SPS" + bytes(range(16)) + b"".join(values) + bytes(4)
    return struct.pack("<I", len(body) + 4) + body


def padded(s):
    b = struct.pack("<I", len(s) + 1) + wide(s + "\0")
    return b + bytes(-len(b) % 4)


def test_property_values(spark):
    blob = store(
        value(2, 7, struct.pack("<d", 36526.25)), value(3, 7, struct.pack("<d", -1.25)), value(4, 6, struct.pack("<q", -12345)), value(5, 0x101F, struct.pack("<I", 2) + padded("é") + padded("abc")),
        value(6, 0x1002, struct.pack("<Ihh", 2, -1, 7)), value(7, 0x1011, struct.pack("<I", 2) + b"\xab\xcd"), value(8, 14, struct.pack("<HBBIQ", 0, 2, 0x80, 0, 150)), value(9, 8, struct.pack("<I", 6) + wide("hi\0")),
    ) + bytes(4)
    good, bad = B.split_errors(B.decode_properties(frame(spark, blob), "b", ["id"]))
    got = {r.property_id: r.value for r in good.collect()}
    assert got == {2: "2000-01-01 06:00:00", 3: "1899-12-29 06:00:00", 4: "-1.2345", 5: json.dumps(["é", "abc"], ensure_ascii=False), 6: '["-1", "7"]', 7: "02000000abcd", 8: "-1.50", 9: "hi"}
    assert bad.count() == 0
    damaged = frame(spark, store(value(2, 0x1003, struct.pack("<I", 2**31))), store(value(2, 7, struct.pack("<d", 1e300))), store(value(2, 0x1000, struct.pack("<I", 2**32 - 1))))
    rows = B.decode_properties(damaged, "b", ["id"]).collect()
    assert [(r.id, r.error is None) for r in sorted(rows, key=lambda r: r.id)] == [(0, False), (1, False), (2, True)]


def block(signature, body):
    return struct.pack("<HHI", len(body) + 8, 1, signature) + body


def test_extension_blocks():
    sps = store(value(2, 31, struct.pack("<I", 3) + wide("ab\0"))) + bytes(4)
    g = [uuid.UUID(int=i) for i in (1, 2)]
    guids = b"".join(x.bytes_le for x in g)
    data = b"".join([
        block(0xBEEF0000, guids), block(0xBEEF0021, sps), block(0xBEEF0010, bytes(8) + sps), block(0xBEEF0026, struct.pack("<Iqqq", 0x11, 1, 2, 3) + b"\0\0" + ITEMS),
        block(0xBEEF0027, sps), block(0xBEEF000E, bytes(8) + guids[:16] + bytes(18) + sps), block(0xBEEF0099, b"??"), block(0xBEEF0026, sps), block(0xBEEF0019, guids[:20]),
    ])
    b = B.parse_blocks(data)
    assert [x["signature"] for x in b] == ["beef0000", "beef0021", "beef0010", "beef0026", "beef0027", "beef000e", "beef0099", "beef0026", "beef0019"]
    text = lambda u: "{" + str(u).upper() + "}"
    assert (b[0]["guid"], b[0]["guid2"]) == (text(g[0]), text(g[1])) and b[5]["guid"] == text(g[0])
    assert [x["properties"][0]["value"] for x in (b[1], b[2], b[4], b[5], b[7])] == ["ab"] * 5 and "properties" not in b[3]
    assert b[3]["ticks"] == [1, 2, 3] and b[3]["idlist"] == ITEMS
    assert set(b[6]) == {"signature", "hex"} and b[8]["guid"] == text(g[0]) and "guid2" not in b[8]


def test_categories_and_archives(spark):
    category = struct.pack("<HBBII", 14, 1, 0, 0, 8) + b"\0\0"
    inner = struct.pack("<H", 44) + b"\x00\0" + bytes(32) + wide("in\0") + bytes(2)
    blob = category + file_entry("A.TXT", "real.7z") + inner + file_entry("B", "b") + b"\0\0"
    seen = {}
    for archives in (False, True):
        rows = B.decode_shell_items(frame(spark, blob, b"", ITEMS), "b", ["id"], archives).orderBy("id", "pos").collect()
        seen[archives] = [(r.id, r.type, r.in_archive) for r in rows]
        assert rows[0].category == 8
    assert seen[False] == [(0, "ControlPanelCategory", False), (0, "FileEntry", False), (0, "Unknown", False), (0, "FileEntry", False), (2, "Volume", False), (2, "FileEntry", False), (2, "FileEntry", False)]
    assert seen[True] == [(0, "ControlPanelCategory", False), (0, "FileEntry", False), (0, "ArchiveContent", True), (0, "ArchiveContent", True), (2, "Volume", False), (2, "FileEntry", False), (2, "ArchiveContent", True)]


def test_folder_paths(spark):
    folders = spark.createDataFrame([("h", 1, None, "root"), ("h", 2, 1, "a"), ("h", 3, 2, "b"), ("g", 1, None, "other")], "host string, id int, parent int, label string")
    items = spark.createDataFrame([("h", 3, "t"), ("g", 1, "t"), ("h", 9, "lost"), ("h", 2, None)], "host string, folder int, name string")
    got = N.folder_paths(items, folders, ["host"], "folder", "name")
    assert got.columns == ["host", "folder", "name", "path"]
    assert sorted((r.host, r.folder, r.path or "") for r in got.collect()) == [("g", 1, "other\\t"), ("h", 2, ""), ("h", 3, "root\\a\\b\\t"), ("h", 9, "")]


def test_orders_of_lists(spark):
    d = frame(spark, order(3, 1, 0xFFFFFFFF, 2), order(0xFFFFFFFF), order(4) + b"\1\2", b"", b"\1")
    assert [r[0] for r in d.select(R.mru_numbers(F.col("b")), "id").orderBy("id").collect()] == [[3, 1], [], [4], None, None]


def test_custom_destinations_are_decoded_once(spark):
    """Files without a good link, damaged ones among them, have one bare row, from the same pass as the links."""
    damaged = B.LNK_HEADER + bytes(3)
    tasks = b"\x02" + bytes(23)
    files = spark.createDataFrame([("h", "damaged", tasks + damaged), ("h", "none", tasks + b"x"), ("h", "short", tasks), ("h", "other", bytes(24) + damaged), (None, "nowhere", tasks + b"x")], "host string, file string, content binary")
    apps = spark.createDataFrame([("none", "none")], "app_id string, name string")
    out, bad = R.jumplist_custom_from_files(files, apps)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = out.collect()
    assert sorted(r.file for r in rows) == ["damaged", "none", "nowhere", "other", "short"]
    assert all(r[c] is None for r in rows for c in out.columns if c not in ("host", "file", "type", "application"))
    assert [r.file for r in bad.collect()] == ["damaged"]


def test_bare_rows_of_values_that_do_not_fit(spark):
    """A blob whose only row is one that its column can't hold counts as without a good row."""
    parse = lambda b: iter([{"n": 2**70}] if b == b"big" else [{"n": 1}] if b == b"ok" else [])
    d = spark.createDataFrame([(1, b"big"), (2, b"ok"), (3, b""), (4, None)], "id int, b binary").coalesce(1)
    got = sorted(((r.id, r.n, r.error is None) for r in B.decode(d, "b", ["id"], "n long", parse, bare=True).collect()), key=repr)
    assert got == [(1, None, False), (1, None, True), (2, 1, True), (3, None, True), (4, None, True)]


def test_values_are_dealt_by_key_before_they_are_sorted(spark):
    """Values of a key in several partitions and cases are one row; no task sorts all that it reads."""
    from hostgrain.operators import raw_inventory as I

    sz = lambda t: bytearray((t + "\0").encode("utf-16-le"))
    rows = [("h", "Amcache", None, f"Root\\InventoryApplication\\{k}", n, "REG_SZ", sz(f"{n.lower()}{k}"), None) for k in range(20) for n in ("Name", "PUBLISHER", "other")]
    got = I.amcache_apps_from_registry(spark.createDataFrame(rows, A.REG_VALUES).repartition(5, "value_name"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [host" in plan.split("Aggregate", 1)[1]
    assert sorted((int(r.id), r.name, r.publisher, r.version) for r in got.collect()) == [(k, f"name{k}", f"publisher{k}", None) for k in range(20)]
