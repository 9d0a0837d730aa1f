"""Queries against their SQL at keys beyond those of the small tables."""

from collections import Counter

import duckdb

import __spark_entry__  # noqa: F401  it registers the queries
from hostgrain.operators import lookups as L
from hostgrain.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, root):
    c = duckdb.connect()
    for path in root.glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    want = c.sql(ORACLE[name])
    return Counter(map(repr, want.fetchall())) == Counter(repr(tuple(r)) for r in QUERIES[name](spark, str(root)).select(*want.columns).collect())


def test_mount_points_of_serials_that_lose_zeros(spark, tmp_path):
    """Numbers 274 and 4354 have one unpadded spelling, 00112."""
    keys = spark.createDataFrame([(k, k % 25) for k in (0, 2, 274, 4354, 4352, 69904, 65552, 2**24 + 16)], "s_suppkey long, s_nationkey int")
    keys.write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    assert same_as_sql(spark, "j7_mount_points", tmp_path)


def test_ambiguous_serial_names_no_volume(spark):
    volumes = spark.createDataFrame([("h", "00000112", "D:"), ("h", "00001102", "E:"), ("g", "00001102", "F:"), ("h", "0A000000", "Z:"), ("h", "a000000", "Y:")], "host string, serial string, letter string")
    links = spark.createDataFrame([(h, s) for h in "hg" for s in ("00112", "00000112", "00001102")] + [("h", "A000")], "host string, serial string")
    got = {(r.host, r.serial): r.mount for r in L.mount_points(links, "serial", volumes).collect()}
    assert got == {("h", "00112"): "", ("h", "00000112"): "D:", ("h", "00001102"): "E:", ("g", "00112"): "F:", ("g", "00000112"): "", ("g", "00001102"): "F:", ("h", "A000"): "Y:"}


def test_recent_docs_beyond_four_digits(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a{k}.example.com/x%41 b", "") for k in (0, 15, 65535, 65536, 65722, 1048576, 2**33 + 5)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert same_as_sql(spark, "t21_recent_docs", tmp_path)
