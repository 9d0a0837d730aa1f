"""From raw documents to training shards: five stages, each one operator over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
A document is a row: rows without a doc_id, or with the doc_id of another text, are judged each by itself. What a stage
decides goes back to its rows by a key of their whole content. Empty tables pass through as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostgrain.llm.common import clear_cuts, cut, cuts_written, table
from hostgrain.llm.decontam import find_windows
from hostgrain.llm.langid import held_out, identify_language, train_language_net
from hostgrain.llm.mixing import fair_mix
from hostgrain.llm.neardup import near_duplicates
from hostgrain.llm.sharding import shard_documents

#: A text whose language is less sure than this goes, with those that have no letter at all.
MIN_SCORE = 0.4
SHARDS = 8
MIX = {"weights": [3, 1, 2], "share": 1.5, "passes": 2}


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``_row``, a hash of all columns (xxhash64 passes over nulls, hence the flags): only rows that are equal
    throughout, and so interchangeable, share it."""
    return docs.withColumn("_row", F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))


def _repeated(rows: DataFrame, columns: list[str], times: Column) -> DataFrame:
    """columns of each distinct row, as often as times says, an aggregate over the rows that share its key."""
    one = rows.groupBy("_row").agg(F.any_value(F.struct(*columns)).alias("_one"), times.cast("int").alias("_times")).filter("_times > 0")
    return one.select("_one", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_one.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and texts of no recognised language. The network learns from the
    labelled rows of docs, as op10 does."""
    rest = [c for c in docs.columns if c != "doc_id"]
    net = train_language_net(docs.filter(~held_out("doc_id")))
    found = identify_language(docs, net, keep=tuple(rest))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by five-word shingles at a similarity of 0.8: the one with the least doc_id,
    null last. Rows without words are linked with nothing and all stay."""
    rows = _keyed(docs)
    found = near_duplicates(rows.select("_row", "text", F.col("doc_id").alias("_id")), k=5, percent=80, id="_row", keep=("_id",))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", F.col("doc_id").alias("row"), "n_shingles"))
    kept = found.groupBy("component_id").agg(first.alias("_first")).select(F.col("_first.row").alias("_row"), F.col("_first.n_shingles").alias("_n"))
    return _repeated(rows.join(kept, "_row"), docs.columns, F.when(F.max("_n") > 0, 1).otherwise(F.count("*")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item (the whole of a shorter one)."""
    rows = _keyed(docs)
    found = find_windows(rows.select("_row", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), id="_row")
    hit = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(hit, "_row", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as their source's target takes them, up to twice."""
    rows = _keyed(docs)
    taken = fair_mix(rows.select("_row", "text", "source"), **MIX, id="_row")
    taken = taken.groupBy(F.col("doc_id").alias("_row")).agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    return _repeated(rows.join(taken, "_row"), docs.columns, F.max("_copies"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document of the mix; copies of a text share a shard."""
    return shard_documents(docs.select("doc_id", "text"), SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The language network can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Once a stage's rows are written, what it and those before it wrote is deleted."""
    docs, since = table(spark, sf_dir, "documents"), cuts_written()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        clear_cuts(spark, since, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
