"""JSON drops: sound, repaired and quarantined files; both time conventions; registry rows; builders."""

import json

import pytest
from pyspark.sql import functions as F

from hostgrain.operators import nested as N
from hostgrain.operators import tables as T
from hostgrain.sources import artefacts as A

SYSTEM = {
    "OsArchitecture": "x64", "OsName": "Windows 11", "ComputerName": "PC", "DomainName": "", "LocalDateTime": "3/2/2023 14h5m6s", "LocalDateTimeUtc": "3/2/2023 12h5m6s", "CurrentTimeZoneId": "1", "CurrentTimeZoneCaption": "P",
    "CurrentBias": "-120", "DaylightInEffect": "true", "Version": "10.0.1", "ServicePack": "0.0",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("drops")

    def put(host, kind, text):
        d = root / f"host={host}"
        d.mkdir(exist_ok=True)
        (d / A.KINDS[kind][0]).write_text(text if isinstance(text, str) else json.dumps(text))

    put("a", "system", SYSTEM)
    put("b", "system", SYSTEM | {"DomainName": "CORP"})
    put("a", "sessions", '[ {"SessionId": "5", "SID": "S-1", "LogonName": "a,}b", "LogonType": "3", "LogonTypeName": "", "StartTime": "1/1/2023 0h0m0s", "StartTimeUtc": "31/12/2022 22h0m0s", }, ]')
    put("b", "sessions", [])
    put("c", "sessions", '[{"SessionId": "5", "SID')
    put("a", "bam", [{"SID": "S-1", "SIDName": "u", "Name": "p.exe", "executionTime": "1/1/2023 10h0m0s", "executionTimeUtc": "1/1/2023 8h0m0s"}])
    put("a", "run", [{"SID": "", "SIDName": "HKLM", "Key": "Run", "Name": "n", "Value": "v", "LastWriteTime": "1/1/2023 12h0m0s", "LastWriteTimeUtc": "1/1/2023 10h0m0s"}])
    put("b", "run", [{"SID": "", "SIDName": "HKLM", "Key": "Run", "Name": "n", "Value": "v", "LastWriteTime": "1/1/2023 5h0m0s", "LastWriteTimeUtc": "1/1/2023 10h0m0s"}])
    put("a", "tasks", '[{"Name": "t", "Description": "an "unescaped" quote"}]')
    bag = {"ID": 1, "Parent": 0, "Source": "S", "LastWriteTimeUtc": "1/1/2023 10h0m0s", "ShellItems": [{"Type": "FileEntry", "Name": "x.zip"}, {"Type": "ArchiveContent", "Name": "in"}]}
    put("a", "shellbags", [{"ID": 0, "Parent": -1, "SID": "S-1", "SIDName": "u", "Source": "S", "LastWriteTime": "", "LastWriteTimeUtc": "", "ShellItems": [], "Childs": [bag | {"Childs": [bag | {"ID": 2, "Childs": []}]}, bag | {"ID": 3}]}])
    put("a", "events", [{f"EvtSystem{k}": v for k, v in {"EventID": "4624", "TimeCreated": "1/1/1601 0h7m0s", "EventRecordId": "77", "Channel": "Security"}.items()} | {"EvtEventData": ["a", "b"], "EvtEventMessage": "m"}])
    return str(root)


def test_system(spark, root):
    rows, bad = A.read_artefact(spark, root, "system")
    got = {r.host: r for r in T.build_system(rows).collect()}
    assert bad.count() == 0 and got["a"].domain == "WORKGROUP" and got["b"].domain == "CORP"
    assert (got["a"].bias, got["a"].dst, str(got["a"].utc_ts)) == (-120, True, "2023-02-03 12:05:06")


def test_repair_and_quarantine(spark, root):
    rows, bad = A.read_artefact(spark, root, "sessions")
    s = T.build_sessions(rows).collect()
    assert [(r.session_id, r.logon_name, r.logon_type_name) for r in s] == [(5, "a,}b", "Network")]
    assert [(r.host, r.reason) for r in bad.collect()] == [("c", "invalid JSON")]
    _, unrepaired = A.read_artefact(spark, root, "sessions", repair=False)
    assert sorted(r.host for r in unrepaired.collect()) == ["a", "c"]
    rows, bad = A.read_artefact(spark, root, "tasks")
    assert rows.count() == 0 and bad.count() == 1


def test_repeated_keys_odd_elements_and_empty_files(spark):
    files = spark.createDataFrame([
        ("a", '[{"SID": "S-1", "SID": "S-2", "Name": "n"}, {"Name": "m", "Data": "1.50"}]'), ("b", '[1, {"Name": "x", "Data": "y"}, null, [2]]'), ("c", ""), ("d", " \r\n"), ("e", None), ("f", "[]"), ("g", "[3]"),
    ], "host string, value string")
    rows, bad = A.parse_drops(files, "muicache")
    assert sorted((r.host, r.pos, r.SID, r.Name, r.Data) for r in rows.collect()) == [("a", 0, "S-2", "n", None), ("a", 1, None, "m", "1.50"), ("b", 1, None, "x", "y")]
    assert sorted((r.host, r.reason, r.text or "") for r in bad.collect()) == [
        ("b", "not an object", "1"), ("b", "not an object", "[2]"), ("b", "not an object", "null"), ("c", "empty file", ""), ("d", "empty file", " \r\n"), ("e", "empty file", ""), ("g", "not an object", "3"),
    ]
    nested = spark.createDataFrame([("a", '[{"ID": 1, "ShellItems": [{"Type": "Network", "Name": "n", "Type": "Server"}]}]')], "host string, value string")
    got = A.parse_drops(nested, "mru")[0].select("ID", F.expr("variant_get(ShellItems, '$[0].Type', 'string')").alias("t")).collect()
    assert [r[:] for r in got] == [(1, "Server")]


def test_gates_and_quarantine(spark):
    from hostgrain.operators import predicates as P

    d = spark.createDataFrame([(1, "a.LNK", b"MZab", "5"), (2, "b", b"M", "x"), (3, None, None, None), (4, "c.lnk.txt", b"MZ", "7")], "id int, path string, content binary, n string")
    assert [r.id for r in P.with_extension(d, "path", ".lnk").collect()] == [1] and [r.id for r in P.of_type(d, "n", "5", "7").collect()] == [1, 4]
    assert [r[0] for r in d.select(P.has_signature(F.col("content"), F.lit(b"MZ"))).collect()] == [True, False, None, True]
    assert [(r.v, r.reason) for r in P.quarantine(d, "n", "int", "v").collect()] == [(5, None), (None, "not a int"), (None, "missing"), (7, None)]
    assert [r[0] for r in d.select(P.counter(F.col("n") == "5", "path", "n")).collect()] == ["a.LNK", "x", None, "7"]


def test_serials_keep_their_spelling(spark):
    """A text that lost the leading zero of some byte isn't filled up in front; it is found by that spelling."""
    from hostgrain.operators import lookups as L

    d = spark.createDataFrame([("h", "1f2ab"), ("h", "01F20A0B"), ("h", "1f20a0b")], "host string, serial string")
    kept = d.withColumn("serial", T.S.serial_kept(F.col("serial")))
    volumes = spark.createDataFrame([("h", "01F20A0B", "D:")], "host string, serial string, letter string")
    assert [(r.serial, r.mount) for r in L.mount_points(kept, "serial", volumes).collect()] == [("1F2AB", "D:"), ("01F20A0B", "D:"), ("1F20A0B", "")]


def test_both_time_conventions_give_one_instant(spark, root):
    bam = T.build_bam(A.read_artefact(spark, root, "bam")[0]).select("exec_ts").first()[0]
    run = [r[0] for r in T.build_run(A.read_artefact(spark, root, "run")[0]).select("key_last_write").collect()]
    assert {bam, *run} == {bam} and str(bam) == "2023-01-01 10:00:00"


def test_shellbags(spark, root):
    b = T.build_shellbags(A.read_artefact(spark, root, "shellbags")[0])
    assert sorted((r.node_path, r.depth, r.id) for r in b.collect()) == [("0", 0, 0), ("0/1", 1, 1), ("0/1/2", 2, 2), ("0/3", 1, 3)]
    items = T.shell_items(b.filter("id = 3").select("id", "items")).orderBy("pos").collect()
    assert [(r.pos, r.item_type, r.name, r.in_archive) for r in items] == [(0, "FileEntry", "x.zip", False), (1, "ArchiveContent", "in", True)]


def test_events_with_impossible_times(spark, root):
    e = T.build_events(A.read_artefact(spark, root, "events")[0]).first()
    assert (e.event_id, e.record_id, e.time_created, e.event_data) == (4624, 77, None, ["a", "b"])


def test_every_kind_has_a_schema(spark, root):
    assert len(A.KINDS) == 23
    for kind in A.KINDS:
        rows, bad = A.read_artefact(spark, root, kind)
        assert rows.columns[:3] == ["source_file", "collected_at", "host"] and bad.columns[-1] == "text"


def test_builders_on_empty_bronze(spark, root):
    users = spark.createDataFrame([], "host string, sid string, name string")
    guids = spark.createDataFrame([], "guid string, name string")
    bronze = {k: A.read_artefact(spark, root, k)[0].limit(0) for k in A.KINDS}
    tasks = T.build_tasks(bronze["tasks"], users)
    prefetch = T.build_prefetch(bronze["prefetch"])
    built = [
        T.build_system(bronze["system"]), tasks, T.build_task_actions(tasks, guids), T.build_task_triggers(tasks), T.build_sessions(bronze["sessions"]), T.build_processes(bronze["processes"]), T.build_process_modules(bronze["processes"]),
        T.build_services(bronze["services"]), T.build_users(bronze["users"]), T.build_usbstor(bronze["usbstor"]), T.build_mounted_devices(bronze["mounted_devices"]), T.build_bam(bronze["bam"]), T.build_muicache(bronze["muicache"]),
        T.build_amcache_app(bronze["amcache_app"]), T.build_amcache_file(bronze["amcache_file"]), T.build_userassist(bronze["userassist"]), T.build_run(bronze["run"]), T.build_shimcache(bronze["shimcache"]), T.build_shellbags(bronze["shellbags"]),
        T.build_mru(bronze["mru"]), T.build_mru_apps(bronze["mru_apps"]), T.build_recent_docs(bronze["recent_docs"]), T.build_jumplist_auto(bronze["jumplist_auto"]), T.build_jumplist_custom(bronze["jumplist_custom"]), prefetch,
        T.build_prefetch_runs(prefetch), T.build_prefetch_volumes(prefetch), T.build_prefetch_dirs(prefetch), T.build_prefetch_files(prefetch), T.build_events(bronze["events"]),
    ]
    assert [d.count() for d in built] == [0] * len(built)


def test_registry(spark):
    w = lambda s: bytearray(s.encode("utf-16-le"))
    rows = [
        ("h", "SYSTEM", None, "Select", "Current", "REG_DWORD", bytearray(b"\x01\0\0\0")), ("h", "SYSTEM", None, "ControlSet001\\bam\\UserSettings\\S-1-5-18", "p.exe", "REG_BINARY", bytearray(b"\x00\x80\x3e\xd5\xde\xb1\x9d\x01")),
        ("h", "SYSTEM", None, "ControlSet002\\bam\\UserSettings\\S-1-5-18", "q.exe", "REG_BINARY", bytearray(8)), ("h", "SOFTWARE", None, "X\\CurrentVersion\\Run", "n", "REG_SZ", w("v\0")),
        ("h", "SOFTWARE", None, "X\\CurrentVersion\\Run", "e", "REG_EXPAND_SZ", w("v\0")), ("h", "S", None, "k", "m", "REG_MULTI_SZ", w("a\0b\0c\0\0")), ("h", "S", None, "k", "none", "REG_SZ", None),
    ]
    reg = spark.createDataFrame([(*r, None) for r in rows], A.REG_VALUES)
    users = spark.createDataFrame([], "host string, sid string, name string")
    own = A.current_control_set(reg)
    bam = T.bam_from_registry(own, users).collect()
    assert [(r.name, r.sid_name, str(r.exec_ts)) for r in bam] == [("p.exe", "SYSTEM", "1970-01-01 00:00:00")]
    assert [(r.name, r.value, r.sid_name) for r in T.run_from_registry(reg, users).collect()] == [("n", "v", "HKLM")]
    assert {r.value_name: r.texts for r in A.reg_typed(reg).filter("texts is not null").collect()} == {"m": ["a", "b", "c"]}


def test_tree_and_take_until(spark):
    df = spark.createDataFrame([(1, 0, "r"), (2, 1, "a"), (3, 2, "b"), (9, 8, "o"), (5, 5, "self")], "id int, up int, name string")
    got = {r.id: (r.path, r.depth, r.root) for r in N.tree_paths(df, [], "id", "up", "name").collect()}
    assert got == {1: ("r", 0, 1), 2: ("r\\a", 1, 1), 3: ("r\\a\\b", 2, 1), 9: ("o", 0, 9), 5: ("self", 0, 5)}
    assert N.tree_paths(df.limit(0), [], "id", "up", "name").count() == 0
    lists = spark.sql("SELECT array(2, 0, 1, -1, 7) AS a UNION ALL SELECT array(3, 4) UNION ALL SELECT array(-1)")
    assert sorted(r[0] for r in lists.select(T.mru_positions(F.col("a"))).collect()) == [[], [2, 0, 1], [3, 4]]


def test_deep_trees_and_cycles(spark):
    rows = [(i, i - 1, f"n{i}") for i in range(1, 71)] + [(101, 102, "a"), (102, 101, "b"), (103, 102, "c")]
    rows += [(201, 200, "first"), (202, 201, "child"), (201, 202, "reused")]  # a cycle that a root reaches
    got = [(r.id, r.path, r.depth, r.root) for r in N.tree_paths(spark.createDataFrame(rows, "id int, up int, name string"), [], "id", "up", "name").collect()]
    assert {d: (i, p.count("\\"), r) for i, p, d, r in got if r == 1} == {d: (d + 1, d, 1) for d in range(70)}
    assert sorted(x for x in got if x[0] > 100) == sorted([(101, "a", None, None), (102, "b", None, None), (103, "c", None, None), (201, "first", 0, 201), (202, "first\\child", 1, 201), (201, "first\\child\\reused", 2, 201)])
    text = '{"ID": 70, "Childs": []}'
    for i in range(69, -1, -1):
        text = f'{{"ID": {i}, "Childs": [{text}]}}'
    deep = N.variant_tree(spark.createDataFrame([("k", text)], "k string, j string"), "j", ["k"], "Childs", {"ID": "int"}).collect()
    assert sorted((r.depth, r.ID) for r in deep) == [(i, i) for i in range(71)]


def test_options_and_sinks(spark, tmp_path):
    assert "events" not in A.Options().kinds() and len(A.Options(events=True).kinds()) == 23
    df = spark.createDataFrame([("h", bytearray(b"ab"))], "host string, content binary")
    assert A.Options(dump=True, md5=True).columns(df).first()[2:] == ("61 62", "187EF4436122D1CC2F40DC2B92F0EBA0")
    for _ in range(2):
        path = A.write_artefact(df.select("host", F.lit(1).alias("x")), str(tmp_path), "run", "json")
    assert spark.read.json(path).count() == 1


def test_texts_are_parsed_once_a_pass(spark):
    """Twice in a plan: as it stands, and repaired. No filter in front of the rows parses it again, and the quarantine is one pass."""
    files = spark.createDataFrame([("a", '[{"Name": "x",}, 5]'), ("b", "[{"), ("c", " \n"), ("d", None), ("e", '{"Name": "y"}'), ("f", "[null, {}]"), ("g", "[]")], "f string, value string")
    rows, bad = A.parse_drops(files.repartition(2), "users")
    for df in (rows, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("VariantExpressionEvalUtils.parseJson(") == 2 and plan.count("Repartition 2") == 1
    assert sorted((r.f, r.pos, r.Name) for r in rows.collect()) == [("a", 0, "x"), ("e", 0, "y"), ("f", 1, None)]
    assert sorted((r.f, r.reason, r.text) for r in bad.fillna("-").collect()) == [
        ("a", "not an object", "5"), ("b", "invalid JSON", "[{"), ("c", "empty file", " \n"), ("d", "empty file", "-"), ("f", "not an object", "null")]
