"""Every registered query with SQL against DuckDB on the small tables; streams against batches."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hostgrain.operators import nested as N
from hostgrain.plans.table_queries import write_host_files
from hostgrain.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((repr(plain(list(r))) for r in got.select(columns).collect()))
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert rows == sorted(repr(plain([r[i] for i in order])) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["x3_tumbling", "x3_sliding", "x3_sessions"])
def test_replay_counts_every_row_of_many_unordered_files(spark, tmp_path, name):
    """More part files than two limited batches take, each with rows of the whole span: the third drops rows."""
    path = f"{tmp_path}/events.parquet"
    spark.read.parquet(f"{SF}/events.parquet").repartition(230, "event_id").write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")  # a task a file
    try:
        got = QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        rows = sorted(repr(plain(list(r))) for r in got.select(columns).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = c.sql(ORACLE[name])
    assert rows == sorted(repr(plain([dict(zip(want.columns, r))[x] for x in columns])) for r in want.fetchall())


def test_host_files_are_bounded(spark, tmp_path):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 50, "big").alias("host"), F.repeat(F.lit("ab"), 100).alias("value"))
    write_host_files(d, str(tmp_path / "out"), file_bytes=10_000)
    files = [p for p in (tmp_path / "out/host=big").rglob("*.txt")]
    assert len(files) > 3 and max(p.stat().st_size for p in files) < 20_000
    assert sorted(r.value for r in spark.read.text([str(p) for p in (tmp_path / "out").rglob("*.txt")]).collect()) == ["ab" * 100] * 400


@pytest.mark.parametrize("name", ["n2_variant_tree", "t19_shellbags"])
def test_nested_texts_are_bounded(spark, tmp_path, monkeypatch, name):
    """A nation of 3,500 customers is several texts and still one tree."""
    spark.range(3500).select(F.col("id").alias("c_custkey"), F.lit(7).alias("c_nationkey"), F.lit("n").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    walk, texts = N.variant_tree, []
    monkeypatch.setattr(N, "variant_tree", lambda df, *a, **k: (texts.append(df), walk(df, *a, **k))[1])
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert texts[0].count() > 3 and Counter(r.depth for r in got) == {0: 1, 1: 3500}


def test_mru_without_an_array_a_user(spark):
    assert "collect_list" not in QUERIES["t20_mru"](spark, SF)._jdf.queryExecution().toString()
