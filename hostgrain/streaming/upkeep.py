"""Tables that are kept up from a stream, batch by batch, so that a batch that is delivered again changes nothing.

A batch leaves partial results in a folder with its number; delivered again, it writes the same folder anew. The table is
what partials merge to. compact() merges them into a version and then writes the ledger's row, which says up to which batch it
reaches: readers take the last version that has such a row, and partials of later batches. A batch that the ledger has already is
skipped. Partials merge by minima, maxima, sums and sketches, in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIALS, VERSIONS, LEDGER = "partials", "versions", "ledger"


@dataclass(frozen=True)
class Kept:
    """What a table holds of each key. starts: name to aggregate over rows; merges: name to aggregate over partials of that
    name; shows: name to expression over merged partials."""

    keys: tuple[str, ...]
    starts: dict[str, Column]
    merges: dict[str, Callable[[str], Column]]
    shows: dict[str, Column]

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.starts.items()))

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*(f(n).alias(n) for n, f in self.merges.items()))

    def shown(self, merged: DataFrame) -> DataFrame:
        return merged.select(*self.keys, *(c.alias(n) for n, c in self.shows.items()))


def first_last_kept(keys: list[str], ts: str, value: str, order: str) -> Kept:
    """First and last instant of each key, the value seen at either, and the number of rows."""
    at = F.struct(ts, order, value)
    return Kept(
        tuple(keys), {"_first": F.min(at), "_last": F.max(at), "_rows": F.count("*")}, {"_first": F.min, "_last": F.max, "_rows": F.sum},
        {"first_ts": F.col(f"_first.{ts}"), "last_ts": F.col(f"_last.{ts}"), "first_value": F.col(f"_first.{value}"), "last_value": F.col(f"_last.{value}"), "rows": F.col("_rows")})


def rarity_kept(keys: list[str], host: str, lg_k: int = 12) -> Kept:
    """Rows of each key and about how many hosts have it, from mergeable sketches."""
    return Kept(
        tuple(keys), {"_hosts": F.hll_sketch_agg(F.col(host).cast("string"), lg_k), "_rows": F.count("*")}, {"_hosts": F.hll_union_agg, "_rows": F.sum},
        {"hosts": F.hll_sketch_estimate("_hosts"), "rows": F.col("_rows")})


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Number to path of a kind's finished folders: those with Spark's mark of success."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    fs = root.getFileSystem(conf)
    found = fs.listStatus(root) if fs.exists(root) else []
    each = [s.getPath() for s in found if "=" in s.getPath().getName()]
    return {int(p.getName().split("=")[1]): p.toString() for p in each if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def reached(spark: SparkSession, path: str) -> tuple[int, int]:
    """The last version of the ledger and the last batch in it; -1 and -1 without any."""
    there = _folders(spark, path, LEDGER)
    if not there:
        return -1, -1
    last = max(there)
    return last, spark.read.parquet(there[last]).head().upto


def take_in(rows: DataFrame, batch: int, path: str, kept: Kept) -> None:
    """One batch's partials; nothing if the ledger has the batch."""
    if batch > reached(rows.sparkSession, path)[1]:
        kept.partial(rows).write.mode("overwrite").parquet(f"{path}/{PARTIALS}/batch={batch}")


def keep_up(stream: DataFrame, path: str, checkpoint: str, kept: Kept) -> None:
    """Takes in all that is there, in as many batches as the stream makes, and ends."""
    stream.writeStream.foreachBatch(lambda rows, batch: take_in(rows, batch, path, kept)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _partials(spark: SparkSession, path: str) -> tuple[DataFrame | None, int, int]:
    """All that is to be merged, the version to come, and the last batch in it."""
    version, upto = reached(spark, path)
    later = {b: p for b, p in _folders(spark, path, PARTIALS).items() if b > upto}
    parts = [_folders(spark, path, VERSIONS)[version]] if version >= 0 else []
    paths = parts + [later[b] for b in sorted(later)]
    return (spark.read.parquet(*paths) if paths else None), version + 1, max(later, default=upto)


def read_kept(spark: SparkSession, path: str, kept: Kept) -> DataFrame | None:
    """The table as of now; None before the first batch."""
    parts, _, _ = _partials(spark, path)
    return None if parts is None else kept.shown(kept.merged(parts))


def compact(spark: SparkSession, path: str, kept: Kept) -> None:
    """Merges all partials so far into one version. If it is cut off before the ledger's row, the version doesn't count and is made again."""
    parts, version, upto = _partials(spark, path)
    if parts is None or upto == reached(spark, path)[1]:
        return
    kept.merged(parts).write.mode("overwrite").parquet(f"{path}/{VERSIONS}/version={version}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{path}/{LEDGER}/version={version}")
