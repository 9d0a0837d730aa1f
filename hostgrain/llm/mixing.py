"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order that depends only on the seed and doc_id, gets a virtual
finish time: the source's words up to and including it, divided by the source's target. Each allowed pass
over a source continues where the one before ended. All entries together are ordered by finish time and cut
where their words reach the total budget, so that every source ends near its target.

Running sums go in two steps (sums per bucket of the shuffle order, then rows within a bucket), so that a
source with a third of all rows is spread over ``BUCKETS`` tasks. The global order is cut through a histogram
of finish times, coarse and then fine within the coarse step that holds the cut: only the entries of one fine
step are ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Buckets of the shuffle order of a source: the first three hex digits of its hash.
BUCKETS = 16**3
#: Steps of the histogram of finish times between 0 and 1, and again within the step that holds the cut.
STEPS = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, passes: int) -> DataFrame:
    """Per source of (source, size): ``source_size`` and ``target``.

    Sources in code-point order, null last, take the weights in turn. Targets are ``min(passes * source_size,
    weight * level)`` with the one level at which they add up to share of all words: what lies above a
    source's limit is shared again by weight. One row per source is handled, never a row per document; these rows are
    sorted in one task, so that sources are meant to be collections, millions of them at most, and not pages.
    """
    order = Window.orderBy(F.col("source").isNull().cast("int"), F.col("source"))
    w = F.array(*(F.lit(float(x)) for x in weights))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_w", F.get(w, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(passes)))
    # Sources reach their limits in the order of limit / weight: before each, what is full and what weight is left.
    full = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull().cast("int"), F.col("source"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    so_far = full.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("_filled", F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0)))
    per = per.withColumn("_left_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(so_far), F.lit(0.0)))
    per = per.withColumn("_level", (F.col("_budget") - F.col("_filled")) / F.col("_left_w"))
    # The level that counts is the first at which the source itself isn't full.
    holds = F.col("_cap") > F.col("_w") * F.col("_level")
    per = per.withColumn("_final", F.min(F.when(holds, F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(everything))
    return per.select(
        "source", "source_size",
        F.coalesce(F.least("_cap", F.col("_w") * F.col("_final.level")), F.col("_cap")).alias("target"),
    )


def fair_mix(docs: DataFrame, weights: list[float], share: float, passes: int = 2, seed: str = "mix", id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, ``copies`` (how often the mix takes the document) and
    ``taken`` (copies * size) for every row of docs.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, after the
    others. Rows that repeat an id are ordered by their size; identical rows are interchangeable. An empty
    table gives an empty result. Other columns of docs are not looked at. Reruns agree: nothing depends on
    partitions or on chance.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = cut(rows)  # texts are read and counted once
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")).withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    targets = source_targets(rows, weights, share, passes).select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_s"), "source_size", "target")

    buckets = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_s", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")).join(targets, "_s")
    within = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_c", F.sum("size").over(within)).join(offsets, ["_s", "_b"])
    placed = cut(placed.withColumn("_c", F.col("_c") + F.col("_offset")))  # read four times below

    def finish(k: int) -> Column:
        return (F.col("_c") + F.col("source_size") * k) / F.col("target")

    def steps(f: Column) -> tuple[Column, Column]:
        """A coarse and, within it, a fine step of the histogram; both grow with f."""
        coarse = F.least(F.floor(f * STEPS), F.lit(STEPS * 4))
        return coarse.cast("int"), F.floor((f * STEPS - coarse) * STEPS).cast("int")

    def entry(k: int) -> Column:
        return F.struct(finish(k).alias("f"), F.col("_h").alias("h"), F.col("doc_id").alias("id"), F.lit(k).alias("k"), F.col("size").alias("n"))

    def edge_of(entries: DataFrame, step: str, start: DataFrame) -> DataFrame:
        """One row: the step at which the words of entries, after those before them, pass the budget."""
        sums = entries.groupBy(step).agg(F.sum("e.n").alias("_n"))
        order = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_upto", F.sum("_n").over(order)).crossJoin(start)
        past = sums.filter(F.col("_before") + F.col("_upto") > F.col("_budget"))
        return past.agg(F.min(F.struct(step, (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_before"), "_budget")).alias("x")).select("x.*")

    total = rows.agg(F.round(F.sum("size") * F.lit(float(share))).cast("long").alias("_budget")).select("_budget", F.lit(0).cast("long").alias("_before"))
    entries = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).select(F.explode(F.array(*map(entry, range(passes)))).alias("e"))
    coarse, fine = steps(F.col("e.f"))
    entries = entries.withColumns({"_coarse": coarse, "_fine": fine})
    edge = cut(edge_of(entries, "_coarse", total))
    inner = entries.join(edge.select("_coarse"), "_coarse")
    fine_edge = cut(edge_of(inner, "_fine", edge.select("_before", "_budget")))
    ordered = Window.orderBy("e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_rows = inner.join(fine_edge, "_fine").withColumn("_run", F.sum("e.n").over(ordered) + F.col("_before"))
    last = last_rows.filter(F.col("_run") <= F.col("_budget")).agg(F.max("e").alias("_last"))
    # One row: the steps of the cut, and the last entry within them that the mix still takes.
    at_cut = edge.agg(F.max("_coarse").alias("_cut")).crossJoin(fine_edge.agg(F.max("_fine").alias("_cut_fine"))).crossJoin(last)
    out = placed.crossJoin(F.broadcast(at_cut))

    def takes(k: int) -> Column:
        coarse, fine = steps(finish(k))
        here = F.coalesce((entry(k) <= F.col("_last")).cast("int"), F.lit(0))
        within = F.when(fine < F.col("_cut_fine"), 1).when(fine > F.col("_cut_fine"), 0).otherwise(here)
        return F.when(F.col("_cut").isNull() | (coarse < F.col("_cut")), 1).when(coarse > F.col("_cut"), 0).otherwise(within)

    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((takes(k) for k in range(passes)), F.lit(0))).otherwise(0).cast("int")
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
