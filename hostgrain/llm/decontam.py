"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of ``size`` consecutive words of a benchmark item (the whole item if it is shorter). A document
that contains a window contains all of the window's shingles, so one of them is enough to find it by: the
necessary prefix of a containment join is the rarest shingle. Shingles are ordered by how often the documents
hold them, each window keeps its rarest one and where it stands in the window, and only document shingles equal
to a kept one are joined. The position in the window and the lengths of window and document bound where the
window would lie; its words are then compared exactly.

Documents' shingles are found in Arrow batches. What lets most of them go before any shuffle is a bit table of
fixed size (``TABLE_BITS``) over the benchmark's shingles, broadcast whatever the benchmark's size: with a larger
benchmark it lets more pass, and the join after it stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .words import ALNUM, Words

SIZE = 10
#: Words of a shingle.
SHINGLE = 5
#: About so many rows of shingles, a multiple of a window's, are held at a time.
ROWS_A_BATCH = 20_000
#: The bit table has 2 ** TABLE_BITS entries: 1 MB.
TABLE_BITS = 23


def _windows(items: DataFrame, size: int, id: str, text: str) -> DataFrame:
    """item_id, window (its words joined by spaces), and each shingle of it: h, at (its first word), k, n (words)."""
    kind = items.select(id).schema[0].dataType

    names = ["item_id", "window", "h", "at", "k", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.column(0).type, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

            def full(out: list[tuple], types=types) -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) or [[]] * 6
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

            out = []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = Words(t, ALNUM)
                n = min(size, len(w))
                if not n:
                    continue
                k = min(SHINGLE, n)
                h = w.shingles(k).view(np.int64)
                for first in range(len(w) - n + 1):
                    window = w.text(first, first + n)
                    out += [(item, window, x, at, k, n) for at, x in enumerate(h[first : first + n - k + 1].tolist())]
                    if len(out) >= ROWS_A_BATCH:
                        yield full(out)
                        out = []
            yield full(out)

    rows = items.select(F.col(id).alias("item_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"item_id {kind.simpleString()}, window string, h long, at int, k int, n int")


def _table(keys: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bit table over the hashes h of keys, and the shingle lengths k that occur. At most 2 ** TABLE_BITS small
    numbers and a few lengths reach the driver."""
    slots = keys.select(F.shiftrightunsigned("h", 64 - TABLE_BITS).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    bits = np.zeros(1 << TABLE_BITS, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little"), sorted(r[0] for r in keys.select("k").distinct().collect())


def _passing(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def find_windows(docs: DataFrame, items: DataFrame, size: int = SIZE, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, ``n_words``, ``hits`` (distinct hit word numbers, in order) and ``items``
    (distinct items with a window in the document) of every row of docs.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null and empty texts have none;
    items without words, or null, have no window. Repeated rows, of documents or items, are kept apart or count once
    as an item; a null item_id is no item. Empty tables give no rows or no hits. Other columns are not looked at.
    """
    spark = docs.sparkSession
    windows = cut(_windows(items.filter(F.col(item_id).isNotNull()), size, item_id, item_text))
    keys = windows.select("h", "k").distinct()
    table, lengths = _table(keys)
    sent = spark.sparkContext.broadcast(table)
    n_words = size  # a window's words around a shingle
    src = docs.select(F.col(id).alias("doc_id"), *keep, F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often documents hold shingles that pass the table: sums per batch, most of them of the benchmark's."""
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                w = Words(t, ALNUM)
                for k in lengths:
                    s = w.shingles(k)
                    found.append(s[_passing(s, sent.value)])
            h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    seen = src.select("_text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("seen"))
    order = Window.partitionBy("window").orderBy("seen", "h", "at")
    every = windows.select("window", "h", "at", "k", "n").distinct().join(seen, "h", "left").fillna(0, ["seen"])
    # A window that holds an unseen shingle is in no document.
    prefix = cut(every.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") == 1) & (F.col("seen") > 0)).select("window", "h", "at", "k", "n"))
    chosen, lengths2 = _table(prefix.select("h", "k").distinct())
    sent2 = spark.sparkContext.broadcast(chosen)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document its words, and of each passing shingle its hash, place and the words around it."""
        for b in batches:
            words, hits = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                w = Words(t, ALNUM)
                words.append(len(w))
                own = []
                for k in lengths2:
                    s = w.shingles(k)
                    at = _passing(s, sent2.value)
                    for p, h in zip(at.tolist(), s[at].view(np.int64).tolist(), strict=True):
                        first = max(0, p - n_words + k)
                        own.append({"h": h, "p": p, "k": k, "first": first, "near": w.text(first, min(len(w), p + n_words))})
                hits.append(own)
            kind = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("k", pa.int32()), ("first", pa.int32()), ("near", pa.string())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words, pa.int64()), pa.array(hits, kind)], [*b.schema.names[:-1], "n_words", "hit"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])
    rows = src.withColumn("_row", F.monotonically_increasing_id()).select("_row", *src.columns)
    probed = rows.mapInArrow(probe, f"_row long, {fields}, n_words long, hit array<struct<h:bigint,p:int,k:int,first:int,near:string>>")
    own = ["_row", *src.columns[:-1], "n_words"]
    one = probed.select(*own, F.explode_outer("hit").alias("_hit"))
    start = F.col("_hit.p") - F.col("at")
    there = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("_hit.near", " "), start - F.col("_hit.first") + 1, F.col("n")), " ") == F.col("window")
    # Rows without a hit get a key of their own, which matches nothing, instead of meeting under null.
    one = one.withColumns({"_h": F.coalesce("_hit.h", F.xxhash64("_row")), "_k": F.coalesce("_hit.k", F.lit(0))})
    joined = one.join(prefix, (F.col("_h") == F.col("h")) & (F.col("_k") == F.col("k")), "left")
    place = F.when(there, F.when(same, F.struct(start.alias("start"), "n", "window")))
    per_doc = joined.groupBy(*own).agg(F.collect_set(place).alias("_places"))
    # The items of the windows that occur: joined by window, for documents that hold any.
    holding = per_doc.withColumn("_w", F.explode_outer(F.array_distinct(F.transform("_places", lambda x: x["window"]))))
    holding = holding.withColumn("_w", F.coalesce("_w", F.concat(F.lit("#"), "_row")))
    owners = windows.select("window", "item_id").distinct()
    owned = holding.join(owners.withColumnRenamed("window", "_w"), "_w", "left")
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("_places", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))))
    out = owned.groupBy(*own, "_places").agg(F.collect_set("item_id").alias("items"))
    return out.select(*src.columns[:-1], "n_words", hit.alias("hits"), "items")


def item_digest(items: str):
    """Lower-case SHA-256 of the item ids, sorted as strings, joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)
