"""Large JSON files in byte ranges against the reader of whole files and plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from hostgrain.sources import artefacts as A
from hostgrain.sources.split_json import objects, read_large

TRICKY = [
    {"Name": 'a "quoted" } brace', "SID": "{[", "Data": "\\"}, {"Name": "\\\\", "SID": "]}", "Data": ""}, {"Name": "", "SID": None, "Data": "x" * 300}, {"Name": "é} 😀 {", "Data": '\\" }'},
    {"Name": "n\n}\t", "SID": "a,b", "Data": {"deep": [{"er": "}"}, [1, {"x": "{"}]]}}, {}, {"SID": "}" * 40},
]


@pytest.fixture()
def small_blocks(spark):
    for k, v in (("maxPartitionBytes", "64"), ("openCostInBytes", "64")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def drop(root, host, text):
    path = root / f"host={host}"
    path.mkdir(parents=True)
    (path / "muicache.json").write_bytes(text.encode())


def test_elements_of_tricky_arrays(spark, tmp_path, small_blocks):
    many = [{"Name": f"n{i}" + "}{\"\\"[i % 4] * (i % 9), "SID": str(i)} for i in range(300)]
    texts = {"pretty": json.dumps(TRICKY, indent=1), "tight": json.dumps(TRICKY, ensure_ascii=False, separators=(",", ":")), "many": json.dumps(many), "one": json.dumps(TRICKY[0]), "none": " [ ] \n", "empty": "", "bom": "﻿" + json.dumps(TRICKY[:2]), "tail": json.dumps(TRICKY[:2]) + "\n\n"}
    for host, text in texts.items():
        drop(tmp_path, host, text)
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "host=many")).rdd.getNumPartitions() > 50
    got = {}
    for r in objects(spark, str(tmp_path), "muicache.json").select(F.regexp_extract("source_file", "host=([^/]+)", 1).alias("host"), "record", "value").collect():
        got.setdefault(r.host, {})[r.record] = json.loads(r.value)
    want = {"pretty": TRICKY, "tight": TRICKY, "many": many, "one": [TRICKY[0]], "bom": TRICKY[:2], "tail": TRICKY[:2]}
    assert {h: [x for _, x in sorted(o.items())] for h, o in got.items()} == want
    assert all(sorted(o) == list(range(len(o))) for o in got.values())


def test_rows_are_those_of_whole_files(spark, tmp_path, small_blocks):
    rows = [{"SID": "S-1", "SIDName": "ann", "Name": f"p{i} }}", "Data": 'd "x" \\'} for i in range(40)]
    drop(tmp_path, "sound", json.dumps(rows))
    drop(tmp_path, "commas", json.dumps(rows[:9]).replace('"}', '", }').replace("}]", "}, ]"))
    drop(tmp_path, "odd", '[{"Name": "a"}, 5, "x}", {"Name": "b"}, [1, {"y": 2}]]')
    columns = ["host", "Name", "Data"]
    whole, bad = A.read_artefact(spark, str(tmp_path), "muicache")
    split, worse = read_large(spark, str(tmp_path), "muicache")
    assert sorted(map(tuple, split.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    assert [(r.host, r.pos) for r in split.filter("host = 'sound'").orderBy("pos").collect()] == [("sound", i) for i in range(40)]
    assert sorted((r.host, r.reason, r.text) for r in worse.collect()) == sorted((r.host, r.reason, r.text) for r in bad.collect())


def test_damage_costs_one_element(spark, tmp_path, small_blocks):
    drop(tmp_path, "h", '[{"Name": "a"}, {"Name": bad}, {"Name": "c"}, {"Name": "d"')
    rows, bad = read_large(spark, str(tmp_path), "muicache")
    assert sorted((r.Name, r.pos) for r in rows.collect()) == [("a", 0), ("c", 2)]
    assert sorted(r.reason for r in bad.collect()) == ["invalid JSON", "invalid JSON"]


def test_sums_move_numbers_only(spark, tmp_path, monkeypatch):
    """What is sorted and summed to find the ends has no paths and no texts."""
    from hostgrain.sources import split_json

    drop(tmp_path, "h", json.dumps(TRICKY))
    written, cut = [], split_json.cut
    monkeypatch.setattr(split_json, "cut", lambda df: written.append(df) or cut(df))
    assert objects(spark, str(tmp_path), "muicache.json").count() == len(TRICKY)
    assert {t for _, t in written[1].dtypes} <= {"bigint", "int"}
