"""Large JSON drops, read in byte ranges.

A drop is one array of objects in one file, which no reader splits. Here it is read as text that ends at every closing
brace, which can begin anywhere; each range of the file is a block. Whether a brace closes an object of the array
depends on all that stands before it, but only through sums: it is outside of strings if the number of quotes before it is even,
and it closes an element if as many brackets are open as at the array's own level. Such sums go in two steps: running
within a block, and over the totals of a file's blocks. Of each piece both readings are counted where it is read, that
it begins in a string and that it doesn't; which one holds is known when the quotes are summed. So the text is scanned
once, the sums move numbers only (files go by 64-bit hashes of their paths), and no task holds more than a block or an object.

A backslash and what follows it can't be torn apart, since no escape ends in a brace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import cut
from .artefacts import KINDS, parse_drops

BRACE = "}"
_ESCAPE = r"\\."
_STRING = '"[^"]*(?:"|$)'


def _times(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


def _depth(bare: Column) -> Column:
    """What a text without strings opens, less what it closes."""
    return _times(bare, "{[") - _times(bare, "]")


def pieces(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """source_file, _block (where its range begins), _seq, value, _size (of the file): texts between closing braces, in order."""
    d = spark.read.option("lineSep", BRACE).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    place = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_modification_time").alias("collected_at")]
    return d.select(*place, F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_seq"), "value")


def objects(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """source_file, collected_at, record (from 0) and value of each element of the files' arrays: its text with whatever
    stands between it and the one before, without the comma. A file that is an object is one record. What stands after
    the last element, but for the closing bracket, is a record as well; so is all from where braces don't balance."""
    d = pieces(spark, root, glob)
    plain = F.regexp_replace("value", _ESCAPE, "")
    d = d.withColumn("_plain", plain).withColumns({
        "_quotes": _times(F.col("_plain"), '"'),
        "_out": _depth(F.regexp_replace("_plain", _STRING, "")),
        "_all": _depth(F.col("_plain")),
        "_head": F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")), 1, 1),
    })
    # What is outside of strings by one reading is inside by the other, so the two make up all brackets.
    d = d.withColumn("_in", F.col("_all") - F.col("_out")).withColumn("_file", F.xxhash64("source_file"))
    d = cut(d.drop("_plain", "_all"))
    before = Window.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    blocks_before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)

    # Quotes: running within the block. A piece that ends outside of strings ends with a brace that counts.
    n = d.drop("value", "source_file", "collected_at", "_size").withColumn("_q", F.coalesce(F.sum("_quotes").over(before), zero) % 2)
    reading = lambda inside: F.when(inside, F.col("_in")).otherwise(F.col("_out")) - F.when((F.col("_quotes") % 2 == 1) == inside, 1).otherwise(0)
    n = n.withColumns({"_even": reading(F.col("_q") == 1), "_odd": reading(F.col("_q") == 0)})
    n = n.withColumns({"_even": F.sum("_even").over(upto), "_odd": F.sum("_odd").over(upto)})
    per_block = n.groupBy("_file", "_block").agg(
        F.sum("_quotes").alias("_quotes"), F.max_by("_even", "_seq").alias("_even"), F.max_by("_odd", "_seq").alias("_odd"), F.min_by("_head", "_seq").alias("_head"))
    per_block = per_block.withColumn("_start", F.coalesce(F.sum("_quotes").over(blocks_before), zero) % 2)
    moved = F.when(F.col("_start") == 1, F.col("_odd")).otherwise(F.col("_even"))
    whole = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_block = per_block.select(
        "_file", "_block", "_start", F.coalesce(F.sum(moved).over(blocks_before), zero).alias("_base"), (F.first("_head").over(whole) == "[").cast("int").alias("_level"))
    n = n.select("_file", "_block", "_seq", "_quotes", "_q", "_even", "_odd").join(per_block, ["_file", "_block"])
    depth = F.col("_base") + F.when(F.col("_start") == 1, F.col("_odd")).otherwise(F.col("_even"))
    ends = ((F.col("_start") + F.col("_q") + F.col("_quotes")) % 2 == 0) & (depth == F.col("_level"))
    n = cut(n.select("_file", "_block", "_seq", ends.cast("int").alias("_ends")))

    # Records: as many as ends before, again within the block and over blocks.
    in_block = n.groupBy("_file", "_block").agg(F.sum("_ends").alias("_total"))
    in_block = in_block.select("_file", "_block", F.coalesce(F.sum("_total").over(blocks_before), zero).alias("_from"))
    n = n.withColumn("_k", F.coalesce(F.sum("_ends").over(before), zero)).join(in_block, ["_file", "_block"])
    n = n.select("_file", "_block", "_seq", (F.col("_from") + F.col("_k")).alias("record"))
    parts = d.select("_file", "_block", "_seq", "value", "source_file", "collected_at", "_size").join(n, ["_file", "_block", "_seq"])
    last = F.max(F.struct("_block", "_seq"))
    found = parts.groupBy("_file", "record").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_seq", "value"))).alias("_parts"), F.first("source_file").alias("source_file"), F.first("collected_at").alias("collected_at"), last.alias("_last"))  # an object's pieces
    text = F.array_join(F.transform("_parts", lambda p: p["value"]), BRACE)
    # Whether a brace follows the last piece, the file's size tells; a mark of three bytes at its beginning isn't read.
    left = F.first("_size") - F.sum(F.octet_length("value") + 1)
    end = parts.groupBy("_file").agg(last.alias("_end"), left.isin(0, 3).alias("_braced"))
    found = found.join(end, "_file").withColumn("_text", F.when((F.col("_last") == F.col("_end")) & ~F.col("_braced"), text).otherwise(F.concat(text, F.lit(BRACE))))
    opened = F.when(F.col("record") == 0, F.regexp_replace("_text", r"^[\s\x{FEFF}]*\[?", "")).otherwise(F.regexp_replace("_text", r"^\s*,?", ""))
    closed = F.when(F.col("_last") == F.col("_end"), F.regexp_replace(opened, r"\s*\]?\s*$", "")).otherwise(opened)
    found = found.select("source_file", "collected_at", "record", closed.alias("value"))
    return found.filter(F.regexp_like("value", F.lit(r"\S")))


def read_large(spark: SparkSession, root: str, kind: str, repair: bool = True, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and quarantine of one kind for all hosts under root, like read_artefact(), from files of any size: elements are
    parsed, repaired and quarantined one by one, so that a damaged one costs only itself. ``pos`` is the element's
    number. Empty files, which hold no element, have no row in either. glob: the files' names, if not the kind's."""
    d = objects(spark, root, glob or KINDS[kind][0]).withColumns({"host": F.regexp_extract("source_file", r"/host=([^/]+)/", 1), "_text": F.concat(F.lit("["), "value", F.lit("]"))})
    rows, bad = parse_drops(d.drop("value"), kind, repair, text="_text")
    return rows.withColumn("pos", F.col("record").cast("int")).drop("record"), bad.drop("record")
