"""Vector compression by product codebooks over per-dimension value dictionaries.

Components are turned into whole numbers and vectors cut into equal parts; each part has a codebook of a few entries, and
a vector's code is the index of the nearest entry of each part. Codebooks are fitted by rounds of assignment and averaging.

Vectors are kept in blocks. A block holds, for each dimension, a dictionary of its distinct whole numbers and each
vector's place in it. A round tabulates the squared differences of every dictionary value to all entries; the distance of
a part is then gathered by the places and added up over its dimensions. All arithmetic is exact: with 64-bit numbers where
those can't overflow, else with Python's.

Blocks are written once and read by each round. A task sends on one sum for each entry's component, so what reaches the
driver is as large as the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_to_one

#: Vectors of a block; their places in a dictionary fit 16 bits.
BLOCK = 4096
#: Below this, components and entries can be squared and summed over a part in 64 bits.
SMALL = 1 << 24
#: Sums travel as digits of this many bits, so that Spark can add them up as longs.
LIMB = 32

Codebooks = list[list[list[int]]]  # part, entry, position within the part


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; scale is a power of two. 64-bit where they are small, else Python's numbers."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    big = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(big, object).reshape(x.shape)


def _block(ids: pa.Array, x: np.ndarray, scale: int) -> tuple:
    """The kept columns of some vectors, and by dimension the dictionary's size, its values as text, and places."""
    values = whole_numbers(x, scale)
    sizes, words, places = [], [], np.empty(values.shape, np.uint16)
    for d in range(values.shape[1]):
        own, places[:, d] = np.unique(values[:, d], return_inverse=True)
        sizes.append(len(own))
        words.append(own)
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    small = flat.astype("<i8").tobytes() if flat.dtype != object else None
    return ids, sizes, small, None if small is not None else [str(v) for v in flat.tolist()], np.ascontiguousarray(places.T).tobytes()


def distances(dictionaries: list[np.ndarray], places: np.ndarray, entries: list[list[int]]) -> np.ndarray:
    """Squared distances of all vectors of a block to the entries of one part."""
    top = max((abs(v) for e in entries for v in e), default=0)
    exact = top >= SMALL or any(d.dtype == object for d in dictionaries)
    total = np.zeros((places.shape[1], len(entries)), object if exact else np.int64)
    for own, at, values in zip(dictionaries, places, zip(*entries, strict=True), strict=True):
        if exact:
            own = own.astype(object)
        differences = own[:, None] - np.array(values, total.dtype)[None, :]
        total += (differences * differences)[at]
    return total


def _read_block(row: dict, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    if row["small"] is not None:
        flat = np.frombuffer(row["small"], "<i8")
    else:
        flat = np.array([int(v) for v in row["big"]], object)
    at = np.cumsum([0, *row["sizes"]])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], np.frombuffer(row["places"], np.uint16).reshape(width, -1)


def assign(dictionaries: list[np.ndarray], places: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """By part and vector: the nearest entry (of equally near ones the first) and the squared distance."""
    nearest, error, w = [], [], len(dictionaries) // len(books)
    for p, entries in enumerate(books):
        d = distances(dictionaries[p * w : (p + 1) * w], places[p * w : (p + 1) * w], entries)
        best = d.argmin(1)
        nearest.append(best)
        error.append(d[np.arange(len(d)), best])
    return np.array(nearest), np.array(error)


def digest(books: Codebooks) -> str:
    """SHA-256 of all components, in order, as decimal numbers with commas between them."""
    return hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()


def _limbs(v: int) -> list[int]:
    """v as digits of LIMB bits from the lowest; the last has the sign."""
    out = []
    while not -(1 << LIMB - 1) <= v < 1 << LIMB - 1:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def _sums(blocks: DataFrame, books: Codebooks, width: int) -> dict[tuple[int, int, int], tuple[int, int]]:
    """By part, entry and position: the sum over the parts that are nearest to the entry, and their number."""
    w = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], list[int]] = {}
        for b in batches:
            for row in b.to_pylist():
                dictionaries, places = _read_block(row, width)
                nearest, _ = assign(dictionaries, places, books)
                for p, best in enumerate(nearest):
                    members = np.bincount(best, minlength=len(books[p]))
                    for i in range(w):
                        own = dictionaries[p * w + i]
                        held = own[places[p * w + i]]
                        sums = np.zeros(len(members), held.dtype)
                        np.add.at(sums, best, held)
                        for e in np.flatnonzero(members):
                            t = totals.setdefault((p, int(e), i), [0, 0])
                            t[0] += int(sums[e])
                            t[1] += int(members[e])
        rows = [(p, e, i, k, limb, n if k == 0 else 0) for (p, e, i), (s, n) in totals.items() for k, limb in enumerate(_limbs(s))]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int32()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["p", "e", "i", "k", "s", "n"])

    parts = blocks.drop("ids").mapInArrow(run, "p int, e int, i int, k int, s long, n long")
    out: dict[tuple[int, int, int], tuple[int, int]] = {}
    for r in parts.groupBy("p", "e", "i", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # as many rows as the codebooks have components, times limbs
        s, n = out.get((r.p, r.e, r.i), (0, 0))
        out[r.p, r.e, r.i] = s + (r.s << LIMB * r.k), n + r.n
    return out


def compress_vectors(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (),
) -> tuple[DataFrame, Codebooks]:
    """vec_id, the columns in keep, ``code`` (two hex digits a part) and ``error`` of every kept vector; and the codebooks.

    Vectors that are null or hold a null, a NaN or an infinity are dropped. The first kept vector (least id, null last; of
    one id, the least vector) sets the number of dimensions, which has to be a positive multiple of parts (vectors of
    which it isn't are dropped, as are those of another length). The first vectors are the first entries; with
    fewer of them than entries, there are fewer entries. Of equally near entries the first is taken; an
    entry that is nearest to nothing stays as it is. error is null where it doesn't fit a long. Repeated rows stay; equal
    vectors have equal codes. An empty table gives an empty result and no codebooks.
    """
    if not 0 < entries <= 256 or scale & (scale - 1) or scale <= 0:
        raise ValueError("entries have to fit two hex digits, and scale has to be a power of two")
    v = F.col("_v")
    src = vectors.select(F.col(id).alias("vec_id"), *(F.col(c) for c in keep), F.col(vector).alias("_v"))
    finite = F.forall(v, lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    fitting = src.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite)
    order = [F.col("vec_id").asc_nulls_last(), v]
    first = fitting.orderBy(*order).select(F.size("_v").alias("n")).head(1)
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in src.schema[:-1])
    if not first:
        return src.filter(F.lit(False)).select(*src.columns[:-1], F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = first[0].n
    kept = fitting.filter(F.size("_v") == width)
    w = width // parts
    seeds = whole_numbers(np.array([r._v for r in kept.orderBy(*order).select("_v").limit(entries).collect()], np.float64), scale)
    books: Codebooks = [[[int(x) for x in s[p * w : (p + 1) * w]] for s in seeds] for p in range(parts)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.StructArray.from_arrays(b.columns[:-1], b.schema.names[:-1])
            flat = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(flat), BLOCK):
                ids, sizes, small, big, places = _block(rows[at : at + BLOCK], flat[at : at + BLOCK], scale)
                own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array([sizes], pa.list_(pa.int32())), pa.array([small], pa.binary()), pa.array([big], pa.list_(pa.string())), pa.array([places], pa.binary())],
                    ["ids", "sizes", "small", "big", "places"])

    blocks = cut(kept.mapInArrow(pack, f"ids array<struct<{fields}>>, sizes array<int>, small binary, big array<string>, places binary"))
    for _ in range(rounds):
        sums = _sums(blocks, books, width)
        books = [[[sums[p, e, i][0] // sums[p, e, i][1] if (p, e, i) in sums else old for i, old in enumerate(entry)] for e, entry in enumerate(part)] for p, part in enumerate(books)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hex2 = np.array([f"{i:02x}" for i in range(256)])
        for b in batches:
            for i, row in enumerate(b.drop_columns(["ids"]).to_pylist()):
                nearest, error = assign(*_read_block(row, width), books)
                codes = ["".join(c) for c in hex2[nearest.T]]
                total = [t if t < 1 << 63 else None for t in map(int, error.sum(0))]
                ids = b.column(0)[i].values
                yield pa.RecordBatch.from_arrays([*ids.flatten(), pa.array(codes, pa.string()), pa.array(total, pa.int64())], [*(f.name for f in ids.type), "code", "error"])

    return blocks.mapInArrow(finish, f"{fields.replace('`: ', '` ')}, code string, error long"), books


def with_group_error(coded: DataFrame, label: str, out: str = "label_error") -> DataFrame:
    """coded with the sum of ``error`` over all rows of equal label, nulls together; null where a row's error is null or
    the sum doesn't fit a long. A label of any share of the rows is summed before it is shuffled and joined without one task for all its rows."""
    rows = coded.withColumns({"_l": F.coalesce(F.col(label).cast("string"), F.lit("")), "_none": F.col(label).isNull()})
    sums = rows.groupBy("_l", "_none").agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias(out), F.count("*").alias("_n"))
    return join_to_one(rows, cut(sums), ["_l", "_none"], rows.count()).drop("_l", "_none")
