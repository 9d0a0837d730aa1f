"""Registered queries, each with the SQL that gives the same rows (or none, where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(c: str | Column) -> Column:
    """A table's zoneless timestamps as instants (the session's zone is UTC)."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")
