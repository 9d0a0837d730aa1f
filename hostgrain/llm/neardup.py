"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Its sketch has ``BANDS * ROWS`` registers, each the truncated
exponent, to base ``BASE``, of the least of exponentially distributed hashes over the set: exponentially spaced
minima that merge by maximum, and of which two sets agree with a probability of nearly their Jaccard
similarity. Documents that agree in all registers of a band share a bucket. With the similarity asked for, the
chance that two documents share none of the buckets is ``(1 - 0.8 ** ROWS) ** BANDS``, 6e-7.

Buckets may hold a third of all documents, so pairs within them are never listed. Documents of equal sets are one
class from the start. Each bucket names as its pivot the member with the largest buckets overall, which is near the
centre of its family, and only pairs with a pivot are examined. Most families are one component after that. Only what
a bucket still holds of different components is compared across them: its documents get a finer sketch, of which one bit
a register is kept, and the join compares these bits, so that just those pairs come out, once each, that agree often
enough; no task compares more than two blocks of ``BLOCK`` members. A pair is examined by a joint likelihood estimate
of its similarity from both sketches, which lets go of pairs that are clearly below, and then verified on the whole sets
(64-bit hashes of all shingles).

Components come from alternating large-star and small-star steps over the links, as joins and aggregations. Wherever one
key may have many rows (a bucket, a pivot, a hub), what is joined to it is broadcast for the bounded number of heavy
keys, or copied to parts, so that its rows stay where they are or are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_copied, join_to_one
from .words import NOT_SPACE, shingle_set

BANDS, ROWS = 36, 5
#: Parameters of the sketch: base, rate and the largest exponent that 16 bits hold.
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
#: A pair goes if the likelihood at the threshold is less than the best by a factor of e to this.
MARGIN = 16.0
#: Registers of the finer sketch, of which the parity is kept; and the same margin in standard deviations of their number.
FINE, SIGMAS = 4096, 5.66
#: Members of a bucket that a task compares with as many others at a time.
BLOCK = 2048

_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_MULT = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_FINE_XOR = _rng.integers(0, 2**64, FINE, dtype=np.uint64)
_FINE_MULT = _rng.integers(0, 2**64, FINE, dtype=np.uint64) | np.uint64(1)


def registers(shingles: np.ndarray, xor: np.ndarray = _XOR, mult: np.ndarray = _MULT) -> np.ndarray:
    """The sketch of a set of hashes: 16-bit registers. Sketches of a union are the maxima of the parts'."""
    least = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    step = (1 << 17) // len(mult)
    for at in range(0, len(shingles), step):
        h = shingles[at : at + step, None] ^ xor
        h *= mult
        np.minimum(least, h.min(0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def _log_likelihood(j, n_u, n_v, more, less, same):
    """Of Jaccard similarity j, given in how many registers the first set has more, less, or the same."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)


def may_reach(n_u: np.ndarray, n_v: np.ndarray, r_u: np.ndarray, r_v: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs (rows) may have the similarity, by size and by the joint likelihood of their registers."""
    small, large = np.minimum(n_u, n_v), np.maximum(n_u, n_v)
    more, less = (r_u > r_v).sum(1), (r_u < r_v).sum(1)
    same = r_u.shape[1] - more - less
    top = small / large
    lo, hi = np.zeros(len(top)), top.copy()
    for _ in range(40):  # the likelihood has one maximum in j
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = _log_likelihood(a, n_u, n_v, more, less, same) < _log_likelihood(b, n_u, n_v, more, less, same)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    best, at = (lo + hi) / 2, np.minimum(percent / 100, top)
    close = _log_likelihood(best, n_u, n_v, more, less, same) - _log_likelihood(at, n_u, n_v, more, less, same) < MARGIN
    return (100 * small >= percent * large) & ((best >= at) | close)


def sketch_documents(docs: DataFrame, k: int, id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, n_shingles, set_key (equal for equal sets, null for empty ones) and registers of every row."""
    src = docs.select(F.col(id).alias("doc_id"), *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, regs = [], [], []
            for t in b.column(b.num_columns - 1):
                s = shingle_set(t.as_py(), k, NOT_SPACE)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                regs.append(registers(s).view(np.int16) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(regs, pa.list_(pa.int16()))], [*b.schema.names[:-1], "n_shingles", "set_key", "registers"])

    return src.mapInArrow(run, f"{fields}, n_shingles long, set_key string, registers array<smallint>")


def _bucket_keys(registers: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice(registers, i * ROWS + 1, ROWS)))


def fine_bits(shingles: np.ndarray) -> np.ndarray:
    """Parities of the finer sketch's registers, 64 to a number. Equal registers agree, others half the time."""
    return np.packbits(registers(shingles, _FINE_XOR, _FINE_MULT) & 1, bitorder="little").view(np.int64)


def most_differing(percent: int) -> int:
    """How many of these bits differ at most in two sets of the similarity, but for chances of 1e-7."""
    q = (1 - percent / 100) / 2
    return int(FINE * q + SIGMAS * (FINE * q * (1 - q)) ** 0.5) + 1


def _examine(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    kind = dict(pairs.dtypes)["a"]
    one = classes.select(F.col("rid").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    two = classes.select(F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    one = one.join(pairs.groupBy("a").agg(F.count("*").alias("_n")), "a")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                x = whole.slice(at, 4096)
                n_a, n_b = (x.column(i).to_numpy().astype(np.float64) for i in (2, 4))
                r_a, r_b = (x.column(i).flatten().to_numpy().view(np.uint16).reshape(x.num_rows, -1) for i in (3, 5))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(may_reach(n_a, n_b, r_a, r_b, percent))) for c in x.columns[:2]], ["a", "b"])

    both = join_to_one(pairs, one, "a", pairs.count()).join(two, "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    likely = cut(both.mapInArrow(estimate, f"a {kind}, b {kind}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for x in batches:
            keep = []
            for a, t, u in zip(x.column(0).to_pylist(), x.column(2), x.column(3), strict=True):
                if left is None or a != last[0] or t != last[1]:
                    last, left = (a, t), shingle_set(t.as_py(), k)
                right = shingle_set(u.as_py(), k)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in x.columns[:2]], ["a", "b"])

    # The text of an a with many pairs goes to several tasks, each of which has a part of them.
    full = join_copied(likely, texts.select(F.col("rid").alias("a"), F.col("text").alias("t_a")), "a", "b").join(texts.select(F.col("rid").alias("b"), F.col("text").alias("t_b")), "b")
    return full.select("a", "b", "t_a", "t_b").mapInArrow(verify, f"a {kind}, b {kind}").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """Per u its least neighbour m, and how many edges it has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own."""
    ends = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return not ends.take(1) and not edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("v")).filter("m <> v").take(1)


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of the links (a, b). Alternates large-star and small-star steps
    until every edge leads to a root; a node's neighbours are never gathered, and those of a hub are dealt to all tasks."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(edges):
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("m", "u"))
        large = join_to_one(both, least, "u", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = cut(large.distinct())
        least = _least(large)
        small = join_to_one(large, least, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, ``n_shingles``, ``component_id`` and ``kept`` of every row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set holds its distinct runs of k words, or the whole
    sequence if it has fewer. Two documents are linked where ``100 * shared >= percent * united``. component_id is the
    least doc_id reachable by links, itself included; kept marks the document that has it. Null texts and those without
    words have empty sets and are linked with nothing. Rows that share a doc_id count as one document; repeated rows are
    all returned. A row with a null id is never kept if its set has another owner. Empty tables give empty results;
    other columns are not looked at.
    """
    sketches = cut(sketch_documents(docs, k, id, text, keep))
    classes = cut(
        sketches.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_key").agg(F.min("doc_id").alias("rid"), F.any_value("n_shingles").alias("n"), F.any_value("registers").alias("registers"))
    )
    rows = classes.select("rid", F.posexplode(_bucket_keys(F.col("registers"))).alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = cut(rows.join(shared, "key"))
    texts = cut(docs.select(F.col(id).alias("rid"), F.col(text).alias("text")).join(members.select("rid").distinct(), "rid", "left_semi"))

    central = members.groupBy("rid").agg(F.sum("members").alias("weight"))
    placed = members.select("key", "rid").join(central, "rid")
    pivots = placed.groupBy("key").agg(F.max(F.struct("weight", "rid"))["rid"].alias("pivot"), F.count("*").alias("_n"))
    to_pivot = join_to_one(members.select("key", "rid"), pivots, "key", members.count()).filter("rid <> pivot")
    pairs = cut(to_pivot.select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct())
    links = cut(_examine(pairs, classes, texts, k, percent))
    found = components(links)

    # What is left: buckets that still hold more than one component.
    named = members.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = cut(named)
    mixed = named.groupBy("key").agg(F.min("component").alias("_c"), F.max("component").alias("_d"), F.count("*").alias("_n")).filter("_c < _d")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks")
    left = join_to_one(named, mixed.select("key", "_n", blocks), "key", named.count())
    left = left.withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    left = cut(left.join(classes.select("rid", "n", "registers"), "rid"))
    kind = dict(left.dtypes)["rid"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [fine_bits(shingle_set(t.as_py(), k)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.list_(pa.int64()))], ["rid", "bits"])

    signs = texts.join(left.select("rid").distinct(), "rid", "left_semi").select("rid", "text").mapInArrow(sign, f"rid {kind}, bits array<bigint>")
    left = cut(left.join(signs, "rid"))
    # A bucket's members are dealt to blocks, and each pair of blocks is a key of the join of its own.
    to = {"a": F.sequence("block", F.col("blocks") - 1), "b": F.sequence(F.lit(0), "block")}
    side = lambda s: left.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rid", "component", "n", "registers", "bits", "block")), F.explode(to[s]).alias(f"other_{s}"), "band")
    one, two = side("a"), side("b").drop("band")
    meet = (one["key"] == two["key"]) & (F.col("block_a") == F.col("other_b")) & (F.col("other_a") == F.col("block_b"))
    apart = F.when(F.col("block_a") == F.col("block_b"), F.col("component_a") < F.col("component_b")).otherwise(F.col("component_a") != F.col("component_b"))
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    differing = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    often = differing <= most_differing(percent)
    # A pair comes out of the first band it shares.
    part = lambda r, i: F.slice(r, i * ROWS + 1, ROWS)
    earlier = F.exists(F.slice(F.sequence(F.lit(0), F.lit(BANDS - 1)), F.lit(1), F.col("band")), lambda i: part(F.col("registers_a"), i) == part(F.col("registers_b"), i))
    across = one.join(two, meet & apart & sizes & often & ~earlier)
    rest = across.select(F.least("rid_a", "rid_b").alias("a"), F.greatest("rid_a", "rid_b").alias("b")).distinct()
    seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(_examine(cut(rest.join(seen, ["a", "b"], "left_anti")), classes, texts, k, percent))
    if more.take(1):
        found = components(links.unionByName(more))

    named = classes.select("set_key", "rid").join(found.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.select("set_key", F.coalesce("component", "rid").alias("_component"))
    out = sketches.select("doc_id", *keep, "n_shingles", F.coalesce("set_key", F.concat(F.lit("none:"), F.xxhash64("doc_id"))).alias("set_key")).join(named, "set_key", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", *keep, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

