"""Writing intermediate tables to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; on a cluster
    an error, since executors don't share local folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back: lineage ends there, and every later reader, on any executor, sees the
    same rows."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_cuts(spark, since: int = 0, keep_last: bool = False) -> None:
    """Delete what cut() has written in this session; call it once the results are stored. since: how many of these tables
    to leave, as cuts_written() gave it before; keep_last: leave the newest as well."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _written[since : len(_written) - keep_last]
    del _written[since : len(_written) - keep_last]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def cuts_written() -> int:
    return len(_written)
