"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents of equal text; its size is the sum of theirs. Every shard has the same capacity. In decreasing
order of size, each group enters the shard with the least room that still holds it, which a balanced tree over the
shards' rooms finds.

The packing needs no groups, only how many there are of each size: groups of equal size fill one shard after another, in
runs. These runs go back to the groups by a join on their size, where each group takes the shard of its place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Buckets that each shard is spread over for running sums; and groups of a bucket among those of one size.
BUCKETS, PER_BUCKET = 1024, 50_000


class RoomTree:
    """Shards ordered by the room they have left: a balanced tree of (room, shard), kept as sorted blocks."""

    BLOCK = 256

    def __init__(self, rooms: list[tuple[int, int]]):
        rooms = sorted(rooms)
        self.blocks = [rooms[i : i + self.BLOCK] for i in range(0, len(rooms), self.BLOCK)]

    def _block(self, item: tuple[int, int]) -> int:
        return bisect_left(self.blocks, item, key=lambda b: b[-1])

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least room of at least size, and its shard."""
        at = self._block((size, -1))
        if at == len(self.blocks):
            return None
        block = self.blocks[at]
        return block[bisect_left(block, (size, -1))]

    def largest(self) -> tuple[int, int]:
        return self.blocks[-1][-1]

    def move(self, item: tuple[int, int], room: int) -> None:
        at = self._block(item)
        block = self.blocks[at]
        del block[bisect_left(block, item)]
        if not block:
            del self.blocks[at]
        new = (room, item[1])
        at = min(self._block(new), len(self.blocks) - 1)
        if at < 0:
            self.blocks.append([new])
            return
        insort(self.blocks[at], new)
        if len(self.blocks[at]) > 2 * self.BLOCK:
            block = self.blocks[at]
            self.blocks[at : at + 1] = [block[: self.BLOCK], block[self.BLOCK :]]


def pack_sizes(sizes: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """Best fit decreasing of (size, number of groups of this size): per size the shards its groups enter in turn, as
    (groups up to and including this shard, shard), and the room left in each shard.

    The capacity is the level at which the shards would be equally full; shards that one oversized group
    alone fills above it are left out of the level. A group that fits nowhere goes where most room is. Where a group
    has entered the tightest shard, that shard is the tightest for the next of equal size, as long as it fits: so groups of
    one size go in runs, and what this takes grows with the number of different sizes.
    """
    left = {size: n for size, n in sorted(sizes, reverse=True) if n}
    plan: dict[int, list[tuple[int, int]]] = {size: [] for size in left}
    over, rest = 0, total
    for size in left:
        while left[size] and over < shards - 1 and size * (shards - over) > rest:
            plan[size].append((len(plan[size]) + 1, over))
            rest -= size
            left[size] -= 1
            over += 1
        if left[size]:
            break
    level = -(-rest // (shards - over))
    room = [0] * over + [level] * (shards - over)
    tree = RoomTree([(level, k) for k in range(over, shards)])
    for size, n in left.items():
        done = plan[size][-1][0] if plan[size] else 0
        while n:
            item = tree.tightest(size)
            take = min(n, item[0] // size) if item else 1
            item = item or tree.largest()
            n, done = n - take, done + take
            plan[size].append((done, item[1]))
            room[item[1]] = item[0] - take * size
            tree.move(item, room[item[1]])
    return plan, room


def pack(groups: list[tuple[int, str]], shards: int, total: int) -> tuple[dict[str, int], list[int]]:
    """The shard of each of (size, group), ties by group, and the room left in each shard."""
    plan, room = pack_sizes(list(Counter(size for size, _ in groups).items()), shards, total)
    turns = {size: (k for done, k, before in zip(*zip(*runs, strict=True), [0, *(d for d, _ in runs)], strict=False) for _ in range(done - before)) for size, runs in plan.items()}
    return {name: next(turns[size]) for size, name in sorted(groups, key=lambda g: (-g[0], g[1]))}, room


def shard_documents(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and ``slot`` of every row of docs.

    Equal texts share a shard; null texts are one group of size 1 each, empty texts another. Slots are
    gapless from 0 in each shard. A group of more than a shard's share fills a shard of its own and the
    others stay equal among themselves. Repeated rows are kept, an empty table gives an empty result, and
    other columns are not looked at.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(
        F.col(id).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.col(text), 256)), F.lit(b"null")).alias("_group"),
    )
    return assign_shards(cut(rows), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def assign_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows: doc_id, size, _group and whatever else is to be kept; adds shard and slot, drops _group. The driver gets how
    many groups each size has, n different sizes at most where all together are n * n / 2."""
    groups = cut(rows.groupBy("_group").agg(F.sum("size").alias("_size")))
    sizes = [(r[0], r[1]) for r in groups.groupBy("_size").agg(F.count("*").alias("_n")).toLocalIterator()]
    plan, _ = pack_sizes(sizes, shards, sum(size * n for size, n in sizes))
    number = dict(sizes)
    table = [(size, [done for done, _ in runs], [k for _, k in runs], 1 + number[size] // PER_BUCKET) for size, runs in plan.items()]
    runs = rows.sparkSession.createDataFrame(table, "_size long, _upto array<long>, _shards array<int>, _buckets int")

    # The place of a group among those of its size, through sums per bucket where there are many.
    placed = groups.join(runs, "_size").withColumn("_b", F.pmod(F.xxhash64("_group"), "_buckets").cast("int"))
    within = Window.partitionBy("_size", "_b").orderBy("_group")
    counts = placed.groupBy("_size", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_size", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = placed.withColumn("_k", F.row_number().over(within)).join(counts, ["_size", "_b"])
    place = F.col("_k") + F.col("_offset")
    shard = F.get("_shards", F.size(F.filter("_upto", lambda e: e < place)))
    assigned = placed.select("_group", shard.alias("shard"))
    return number_slots(rows.join(assigned, "_group").drop("_group"))


def number_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, through sums per bucket, so that no task holds a shard."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_b").orderBy("doc_id", *[c for c in ("text_crc32", "size") if c in rows.columns])
    numbered = rows.withColumn("_k", F.row_number().over(within)).join(counts, ["shard", "_b"])
    return numbered.withColumn("slot", (F.col("_k") - 1 + F.col("_offset")).cast("long")).drop("_b", "_k", "_offset")
