"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import clear_cuts, cut, cuts_written, scratch, shared_dir

__all__ = ["ascii_lower", "clear_cuts", "cut", "cuts_written", "join_copied", "join_to_one", "scratch", "shared_dir", "table"]

#: A key is heavy if it holds more than one row in HEAVY_SHARE, and more than LIGHT: so at most HEAVY_SHARE keys are.
HEAVY_SHARE, LIGHT = 10_000, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else (lower() also maps letters beyond ASCII)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def heavy_limit(total: int) -> int:
    return max(LIGHT, total // HEAVY_SHARE)


def join_to_one(rows: DataFrame, ones: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """rows joined with ones, which has one row a key (one column or several) and in ``_n`` how many of the total rows hold the key. No task gets
    all rows of a heavy key: what ones has for these, HEAVY_SHARE rows at most, is broadcast; the others are shuffled."""
    limit = heavy_limit(total)
    heavy = ones.filter(F.col("_n") > limit)
    spread = rows.join(F.broadcast(heavy), key)
    shuffled = rows.join(F.broadcast(heavy.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(ones.filter(F.col("_n") <= limit), key)
    return spread.unionByName(shuffled).drop("_n")


def join_copied(rows: DataFrame, ones: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with ones, which has one row a key that may be too large to be broadcast. A heavy key's is copied to as
    many parts as the key's rows, dealt by a hash of the column by, need; just these numbers of parts are broadcast."""
    limit = heavy_limit(rows.count())
    heavy = rows.groupBy(key).agg(F.ceil(F.count("*") / limit).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copied = ones.join(F.broadcast(heavy), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")
