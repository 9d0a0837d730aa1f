"""Prefixes, evidence of six tables, removable media and bags against plain Python."""

import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from hostgrain.operators import analytics as D
from hostgrain.operators import lookups as L
from hostgrain.operators import raw_tables as R
from hostgrain.operators import scan
from hostgrain.operators import tables as T
from hostgrain.sources import artefacts as A

from .test_decode import ITEMS, file_entry

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("limit", [10**9, 40])
def test_prefixes_of_any_length(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "ROWS_A_TASK", limit)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    dims = [(r.choice("xy"), word(r.randrange(0, 7)), i, f"v{i}") for i in range(60)] + [("x", None, 99, "none")]
    texts = [(i, r.choice(["x", "y", "z"]), word(r.randrange(0, 12))) for i in range(300)] + [(900, "x", None), (901, "x", ""), (901, "x", "")]
    df = spark.createDataFrame(texts, "id int, host string, t string").repartition(4)
    dim = spark.createDataFrame(dims, "host string, p string, o int, v string")

    def best(host, text):
        fit = [(o, v) for h, p, o, v in dims if p and text is not None and text.startswith(p) and (host is None or h == host)]
        return min(fit)[1] if fit else None

    got = L.prefix_join(df, "t", dim, "p", "o", keys=("host",))
    assert got.columns == ["id", "host", "t", "p", "o", "v"]
    assert sorted((x.id, x.v or "") for x in got.collect()) == sorted((i, best(h, t) or "") for i, h, t in texts)
    got = L.prefix_join(df, "t", dim.drop("host"), "p", "o")
    assert sorted((x.id, x.v or "") for x in got.collect()) == sorted((i, best(None, t) or "") for i, h, t in texts)
    assert L.prefix_join(df, "t", dim.limit(0), "p", "o", keys=("host",)).filter("v IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        L.prefix_join(df, "t", dim.withColumnRenamed("v", "id"), "p", "o", keys=("host",))


def test_evidence_of_six_tables(spark):
    t = [T0 + dt.timedelta(hours=i) for i in range(9)]
    dev = "\\Device\\HarddiskVolume1"
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    prefetch = make([("h", "C:\\A.EXE", [t[0], t[2]]), ("h", "C:\\B.EXE", []), ("h", None, [t[1]])], "host string, full_path string, runs array<timestamp>")
    bam = make([("h", dev + "\\a.exe", t[5]), ("h", dev + "0\\a.exe", t[6]), ("g", dev + "\\a.exe", t[7])], "host string, name string, exec_ts timestamp")
    two = "host string, {} string, {} timestamp"
    ua, sc, am = make([("h", "c:\\a.exe", None)], two.format("name", "last_ts")), make([("h", "C:\\b.exe", t[3])], two.format("path", "last_mod_ts")), make([("h", "", t[3])], two.format("long_path", "link_ts"))
    mui = make([("h", "C:\\a.exe.FriendlyAppName"), ("h", "C:\\a.exe.ApplicationCompany")], "host string, name string")
    volumes = make([("h", dev, "C:")], "host string, device string, letter string")
    out = D.execution_evidence(D.evidence_of_tables(prefetch, bam, ua, sc, am, mui, volumes), D.EVIDENCE)
    got = {(r.host, r.program): (*(r[f"n_{s}"] for s in D.EVIDENCE), r.first_ts, r.last_ts) for r in out.collect()}
    assert got == {
        ("h", "c:\\a.exe"): (2, 1, 1, 0, 0, 2, t[0], t[5]), ("h", "c:\\b.exe"): (1, 0, 0, 1, 0, 0, t[3], t[3]),
        ("h", dev.lower() + "0\\a.exe"): (0, 1, 0, 0, 0, 0, t[6], t[6]), ("g", dev.lower() + "\\a.exe"): (0, 1, 0, 0, 0, 0, t[7], t[7]),
    }


def test_removable_media(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    usb = spark.createDataFrame([("h", "AB12&0"[:4]), ("h", "CD34"), ("g", "EF56")], "host string, serial string")
    device = lambda s: f"_??_USBSTOR#Disk&Ven#{s}&0#{{53f5}}"
    mounts = [("h", "E:", device("ab12"), 0), ("h", "E:", device("CD34"), 10), ("h", "E:", None, 20), ("h", "C:", "DMIO:ID:x", 0), ("g", "E:", device("ab12"), 0)]
    mounts = spark.createDataFrame([(h, d, x, at(m)) for h, d, x, m in mounts], "host string, drive string, device string, ts timestamp")
    links = [(1, "h", "E:", "V1", 5), (2, "h", "E:", "V2", 10), (3, "h", "E:", "V3", 25), (4, "h", "E:", None, -1), (5, "h", "C:", "V1", 7), (6, "g", "X:", "V2", 1), (7, "g", "E:", "V1", 5), (8, "h", "E:", "V2", 12), (9, "h", "E:", "V4", 5), (10, "h", "E:", "V4", 15), (11, "h", "F:", "V4", 15)]
    df = spark.createDataFrame([(i, h, d, v, at(m)) for i, h, d, v, m in links], "id int, host string, drive string, vol_serial string, ts timestamp")
    got = {r.id: (r.serial, r.way) for r in D.media_trail(usb, mounts, df).collect()}
    assert got == {
        1: ("AB12", "letter"), 2: ("CD34", "letter"), 3: (None, None), 4: (None, None), 5: ("AB12", "volume"), 6: ("CD34", "volume"), 7: ("AB12", "volume"), 8: ("CD34", "letter"),
        9: ("AB12", "letter"), 10: ("CD34", "letter"), 11: (None, None),  # V4 was seen on two devices
    }


def order(*numbers):
    return struct.pack(f"<{len(numbers)}I", *numbers)


def test_bags_from_the_registry(spark):
    top = "Local Settings\\Software\\Microsoft\\Windows\\Shell\\BagMRU"
    folder, archive = file_entry("D", "d") + b"\0\0", file_entry("A.ZIP", "a.zip") + b"\0\0"
    end = 0xFFFFFFFF
    rows = [
        (top, "MRUListEx", order(2, 0, 1, end, 7)), (top, "0", folder), (top, "1", archive), (top, "7", folder),
        (top + "\\0", "MRUListEx", order(0, 5)), (top + "\\0", "0", ITEMS), (top + "\\0", "5", b"\xff\x00zz"),
        (top + "\\1", "mrulistex", order(3)), (top + "\\1", "3", archive), (top + "\\1\\3", "MRUListEx", order(4, 4)), (top + "\\1\\3", "4", folder),
        (top + "\\7", "MRUListEx", order(0)), (top + "\\7", "0", folder), ("Other\\Bags", "MRUListEx", order(0)),
    ]
    for sid in ("S-1", None):
        reg = spark.createDataFrame([("h", "usr", sid, k, n, "REG_BINARY", bytearray(d), T0) for k, n, d in rows], A.REG_VALUES)
        users = spark.createDataFrame([("h", "S-1", "ann")], "host string, sid string, name string")
        got = {r.node_path: r for r in R.shellbags_from_registry(reg, users).collect()}
        assert {p: (r.id, r.parent, r.depth, r.mru_pos, r.in_archive) for p, r in got.items()} == {
            "2": (2, None, 0, 0, False), "0": (0, None, 0, 1, False), "1": (1, None, 0, 2, False),  # below 7, which isn't listed, nothing
            "0/0": (0, 0, 1, 0, False), "0/5": (5, 0, 1, 1, False), "1/3": (3, 1, 1, 0, True), "1/3/4": (4, 3, 2, 0, True),
        }
        assert got["2"]["items"] is None and got["2"].error == "no value" and got["0/5"].error and got["0"].error is None and got["1"].sid_name == ("ann" if sid else "")
        kinds = {p: [(i.type, i.in_archive) for i in r["items"]] for p, r in got.items() if p in ("1", "1/3", "1/3/4")}
        assert kinds == {"1": [("FileEntry", False)], "1/3": [("ArchiveContent", True)], "1/3/4": [("ArchiveContent", True)]}
        assert R.shellbags_from_registry(reg.limit(0), users).count() == 0


def test_items_of_bags_meet_their_rows_without_a_join(spark, monkeypatch):
    """Of joins by node only that with its path is left; what the tree's rounds take is theirs."""
    rounds, end, R_TREE = [], 0xFFFFFFFF, R.tree_paths
    top = "Local Settings\\Software\\Microsoft\\Windows\\Shell\\BagMRU"
    order = lambda *n: b"".join(i.to_bytes(4, "little") for i in n)
    reg = spark.createDataFrame([("h", "usr", "S-1", top, n, "REG_BINARY", bytearray(b), None) for n, b in (("MRUListEx", order(1, 0, end)), ("1", ITEMS))], A.REG_VALUES)
    users = spark.createDataFrame([("h", "S-1", "ann")], "host string, sid string, name string")
    kept, joins = R.cut, []
    monkeypatch.setattr(R, "tree_paths", lambda *a, **b: rounds.append(1) or kept(R_TREE(*a, **b)))
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    monkeypatch.setattr(R, "cut", lambda df: joins.append(count(df)) or kept(df))
    out = R.shellbags_from_registry(reg, users)
    assert {(r.id, r.mru_pos, r.error) for r in out.collect()} == {(1, 0, None), (0, 1, "no value")} and len(rounds) == 1
    assert sum(joins) + count(out) == 3  # orders with values, rows with paths, and accounts


def test_bags_from_json(spark):
    item = lambda n: f'{{"Type": "FileEntry", "Name": "{n}"}}'
    node = lambda i, items, kids="": f'{{"ID": {i}, "ShellItems": [{items}], "Childs": [{kids}]}}'
    j = node(9, item("a.zip"), node(1, item("x"), node(2, item("y"))) + "," + node(3, item("z")))
    b = spark.createDataFrame([("h", "S", j), ("h", "T", node(8, item("b") + "," + item("c.rar") + "," + item("d"), node(4, item("e"))))], "host string, SID string, j string").withColumn("v", F.parse_json("j"))
    get = lambda c, t: F.try_variant_get("v", f"$.{c}", t).alias(c)
    b = b.select("host", "SID", get("ID", "bigint"), F.lit(0).alias("Parent"), F.lit("BagMRU").alias("Source"), F.lit("").alias("LastWriteTime"), F.lit("").alias("LastWriteTimeUtc"), get("ShellItems", "variant"), get("Childs", "variant"))
    bags = T.build_shellbags(b)
    assert {(r.node_path, r.mru_pos, r.in_archive) for r in bags.collect()} == {("9", None, False), ("9/1", 0, True), ("9/1/2", 0, True), ("9/3", 1, True), ("8", None, False), ("8/4", 0, True)}
    items = {(r.node_path, r.pos): (r.name, r.in_archive) for r in T.shell_items(bags.select("node_path", "in_archive", "items")).collect()}
    assert items == {("9", 0): ("a.zip", False), ("9/1", 0): ("x", True), ("9/1/2", 0): ("y", True), ("9/3", 0): ("z", True), ("8", 0): ("b", False), ("8", 1): ("c.rar", False), ("8", 2): ("d", True), ("8/4", 0): ("e", True)}


def test_event_folders_are_pruned(spark, tmp_path):
    rows = [(i, f"h{i % 4}", "ab"[i % 2], T0 + dt.timedelta(days=i % 5) if i % 11 else None) for i in range(200)]
    events = spark.createDataFrame(rows, "record_id long, host string, channel string, time_created timestamp")
    root = str(tmp_path / "events")
    A.write_events(events, root)
    assert sorted(r.record_id for r in A.read_events(spark, root).collect()) == list(range(200))
    dim = spark.createDataFrame([("h1", 1), ("h2", 2)], "host string, site int")
    dim.write.parquet(str(tmp_path / "dim"))
    hosts = spark.read.parquet(str(tmp_path / "dim")).filter("site = 1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = A.read_events(spark, root, ["record_id"], ["b"], ("2024-01-02", "2024-01-03"), hosts)
    assert sorted(r.record_id for r in got.collect()) == [i for i, h, c, t in rows if h == "h1" and c == "b" and t and t.day in (2, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan_of = next(x for x in plan.splitlines() if "FileScan" in x and "PartitionFilters" in x and "channel" in x)
    filters = scan_of.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "channel" in filters and "day" in filters and "dynamicpruning" in filters and "time_created" not in scan_of


def test_inventories_from_the_registry(spark):
    from hostgrain.operators import raw_inventory as I

    wide = lambda t: bytearray((t + "\0").encode("utf-16-le"))
    app, file, cache = "Root\\InventoryApplication\\a1", "Root\\InventoryApplicationFile\\f1", "SYSTEM\\ControlSet001\\Control\\Session Manager\\AppCompatCache"
    record = b"10ts" + bytes(8) + struct.pack("<H", 4) + "ab".encode("utf-16-le") + struct.pack("<q", 116444736000000000) + struct.pack("<I", 4) + struct.pack("<HH", 1, 0)
    rows = [
        (app, "name", "REG_SZ", wide("App")), (app, "InstallDate", "REG_SZ", wide("02/03/2021 04:05:06")), (app, "Version", "REG_SZ", None), (app, "Other", "REG_SZ", wide("x")), (app + "\\deep", "Name", "REG_SZ", wide("no")),
        ("Root\\InventoryApplication\\a2", "InstallDate", "REG_SZ", wide("never")), (file, "IsOsComponent", "REG_DWORD", bytearray(struct.pack("<I", 1))), (file, "LowerCaseLongPath", "REG_SZ", wide("c:\\x")),
        (cache, "AppCompatCache", "REG_BINARY", bytearray(struct.pack("<I", 4) + record + b"10xx")), (cache, "Other", "REG_BINARY", bytearray(b"")),
    ]
    reg = spark.createDataFrame([("h", "H", None, k, n, t, d, None) for k, n, t, d in rows], A.REG_VALUES)
    apps = {r.id: r for r in I.amcache_apps_from_registry(reg).collect()}
    assert set(apps) == {"a1", "a2"} and (apps["a1"].name, apps["a1"].version, apps["a1"].install_ts) == ("App", None, dt.datetime(2021, 2, 3, 4, 5, 6))
    assert apps["a2"].name is None and apps["a2"].install_ts is None
    assert [(r.id, r.long_path, r.is_os_component, r.link_ts) for r in I.amcache_files_from_registry(reg).collect()] == [("f1", "c:\\x", True, None)]
    good, bad = I.shimcache_from_registry(reg)
    assert [tuple(r) for r in good.collect()] == [("h", 0, "ab", dt.datetime(1970, 1, 1), True)] and [r.host for r in bad.collect()] == ["h"]
    assert I.amcache_apps_from_registry(reg.limit(0)).count() == 0
