"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one row in HEAVY_SHARE, and more than LIGHT: so at most HEAVY_SHARE keys are.
HEAVY_SHARE, LIGHT = 10_000, 1_000_000


def join_to_one(rows: DataFrame, ones: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with ones, which has at most one row a key; how: inner or left. total: about how many rows there are.
    No task gets all rows of a heavy key: what ones has for heavy keys, HEAVY_SHARE rows at most, is broadcast to where
    the rows lie; the others are shuffled. Where all rows together are light, it is a plain join."""
    limit = max(LIGHT, total // HEAVY_SHARE)
    if total <= limit:
        return rows.join(ones, keys, how)
    heavy = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit).select(*keys)
    held = F.broadcast(heavy)
    spread = rows.join(held, keys, "left_semi").join(F.broadcast(ones.join(held, keys, "left_semi")), keys, how)
    return spread.unionByName(rows.join(held, keys, "left_anti").join(ones, keys, how))
