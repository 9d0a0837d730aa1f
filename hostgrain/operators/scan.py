"""Running values of each key in order, without a task that gets all rows of a key.

A key of moderate size is a window. The rows of a heavy one are dealt by ranges of key and order, so that they lie in many
partitions, each of which holds a stretch of the order. What is running is then found in two steps: within the stretch, and by what
the stretches before it leave, of which there are as many as partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: A key of more rows is heavy.
ROWS_A_TASK = 4_000_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, (a[k].eqNullSafe(b[f"_k_{k}"]) for k in keys), F.lit(True))


def _named(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *more)


def _parted(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of moderate keys, and those of heavy ones; None if there are none."""
    heavy = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > ROWS_A_TASK)
    heavy = _named(heavy, keys)
    if not heavy.take(1):
        return df, None
    heavy = cut(heavy)
    held = F.broadcast(heavy)  # as many keys as rows of a task fit into all rows
    return df.join(held, _same(df, heavy, keys), "left_anti"), df.join(held, _same(df, heavy, keys), "left_semi")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with running values up to each row of its key: sums of numbers (null counts as 0) and last values that aren't null. The order
    should not leave ties, else theirs is open. Null keys are keys; with no keys all rows are one."""
    if not keys:
        return running(df.withColumn("_all", F.lit(0)), ["_all"], order, sums, lasts).drop("_all")
    sums, lasts = {n: F.coalesce(c, F.lit(0)) for n, c in (sums or {}).items()}, lasts or {}

    def within(rows: DataFrame, own: list[str], names: dict[str, str]) -> DataFrame:
        w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({**{names[n]: F.sum(c).over(w) for n, c in sums.items()}, **{names[n]: F.last(c, ignorenulls=True).over(w) for n, c in lasts.items()}})

    names = {n: n for n in (*sums, *lasts)}
    light, heavy = _parted(df, keys)
    out = within(light, keys, names)
    if heavy is None:
        return out
    d = cut(heavy.repartitionByRange(*keys, *order).withColumn("_b", F.spark_partition_id()))
    local = {n: f"_l_{n}" for n in names}
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    d = cut(within(d, [*keys, "_b"], local).withColumn("_place", place))
    ends = d.groupBy(*keys, "_b").agg(*(F.max_by(c, "_place").alias(c) for c in local.values()))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumns({f"_c_{n}": (F.sum(local[n]) if n in sums else F.last(local[n], ignorenulls=True)).over(before) for n in names})
    carry = _named(carry.withColumnRenamed("_b", "_at"), keys, "_at", *(f"_c_{n}" for n in names))
    joined = d.join(carry, _same(d, carry, keys) & (d["_b"] == carry["_at"]))
    total = {n: F.col(local[n]) + F.coalesce(f"_c_{n}", F.lit(0)) if n in sums else F.coalesce(local[n], f"_c_{n}") for n in names}
    return out.unionByName(joined.withColumns(total).select(*out.columns))
