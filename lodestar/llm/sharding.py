"""Sharding by best-fit decreasing.

Documents with equal texts are one indivisible group. Groups enter the packing by their exact
size, largest first, each into the bin with the least room that still takes it, found in a
balanced search tree of the remaining capacities. Groups of one size are alike, so the packing
works on runs (size, number of groups): of D different sizes, D * D / 2 is no more than the
bytes of the corpus, which bounds the runs that the driver gets (32,000 at 0.5 GB, 14 million
at 100 TB). A run's groups are dealt to its bins by their rank.

shard() finds the least capacity for which a fixed number of bins is enough; law of its result:
bytes, as bins differ by as little as indivisible groups allow. shard_by_capacity() takes as
many bins of a fixed capacity as the packing opens.

Defined results: null text counts as empty and forms a group with the empty texts; rows
that repeat get a slot each; a group above the capacity gets a bin of its own size; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small

OVERHEAD = 8
#: Rows that one task numbers.
NUMBERED = 50_000


class _Node:
    __slots__ = ("key", "left", "right", "rank")

    def __init__(self, key: tuple[int, int], rank: int):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class Bins:
    """Remaining capacities in a balanced search tree (a treap whose ranks are hashed from the bin's number)."""

    def __init__(self, capacity: int, n: int):
        self.capacity, self.n, self.opened, self.root = capacity, n, 0, None

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def _split(self, t: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        """What is below key, and the rest."""
        if t is None:
            return None, None
        if t.key < key:
            t.right, rest = self._split(t.right, key)
            return t, rest
        below, t.left = self._split(t.left, key)
        return below, t

    def place(self, size: int, count: int = 1) -> list[tuple[int, int]] | None:
        """Bins for count items of a size, as (bin, items): each time the one with the least room that takes the next item,
        a new one if there is none; None beyond n bins. That bin stays the one with the least room until it takes no more."""
        out = []
        while count:
            below, fits = self._split(self.root, (size, -1))
            if fits is not None:
                least = fits
                while least.left is not None:
                    least = least.left
                room, b = least.key
                _, fits = self._split(fits, (room, b + 1))
            elif self.opened < self.n:
                room, b = max(self.capacity, size), self.opened
                self.opened += 1
            else:
                self.root = below
                return None
            taken = min(count, room // size) if size else count
            room, count = room - taken * size, count - taken
            out.append((b, taken))
            self.root = self._merge(below, fits)
            low, high = self._split(self.root, (room, b))
            self.root = self._merge(self._merge(low, _Node((room, b), (b * 0x9E3779B1 + 1) % (1 << 32))), high)
        return out


def pack(runs: list[tuple[int, int]], capacity: int, n: int) -> list[list[tuple[int, int]]] | None:
    """Best-fit decreasing: for each run (size, count) its (bin, items); None if n bins of capacity don't do. runs: sizes descending."""
    bins = Bins(capacity, n)
    out = []
    for size, count in runs:
        got = bins.place(size, count)
        if got is None:
            return None
        out.append(got)
    return out


def pack_evenly(runs: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Best-fit decreasing into n bins of a least capacity: steps that double from the mean up find one that does, bisection the least."""
    if not runs:
        return []
    low = max(runs[0][0], -(-sum(s * c for s, c in runs) // n))
    step, tried = 1, low - 1
    while (best := pack(runs, low, n)) is None:
        tried, low, step = low, low + step, step * 2
    high = low
    while high - tried > 1:
        mid = (tried + high) // 2
        got = pack(runs, mid, n)
        if got is None:
            tried = mid
        else:
            best, high = got, mid
    return best


def shard(spark: SparkSession, docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs, in n_shards shards."""
    return _sharded(spark, docs, lambda runs: pack_evenly(runs, n_shards))


def shard_by_capacity(spark: SparkSession, docs: DataFrame, capacity: int) -> DataFrame:
    """The same in as few shards of a capacity in bytes as best-fit decreasing opens."""
    return _sharded(spark, docs, lambda runs: pack(runs, capacity, 1 << 62))


def _sharded(spark: SparkSession, docs: DataFrame, packing) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group"))
    d = checkpointed(d)
    # rows of a group are counted before they are sent
    groups = d.groupBy("_group").agg(F.sum("size").alias("bytes"))
    groups = checkpointed(groups)
    runs = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bytes").desc()).toPandas()
    sizes = list(zip(runs["bytes"].astype(int).tolist(), runs["n"].astype(int).tolist()))
    rows = []
    for (size, _), got in zip(sizes, packing(sizes)):
        first = 0
        for b, taken in got:
            rows.append((size, first, first + taken, b))
            first += taken
    dealt = pd.DataFrame(rows, columns=["_bytes", "_from", "_to", "shard"])
    dealt = spark.createDataFrame(dealt, "_bytes long, _from long, _to long, shard int") if rows else spark.createDataFrame([], "_bytes long, _from long, _to long, shard int")
    ranked = number(groups, ["bytes"], ["_group"], "_rank")
    placed = ranked.join(small(dealt), (F.col("bytes") == F.col("_bytes")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(F.col("_group").alias("_g"), "shard")
    out = d.join(placed, F.col("_group") == F.col("_g")).select("doc_id", "size", "text_crc32", "shard")
    return number(checkpointed(out), ["shard"], ["doc_id", "text_crc32"], "slot")


def number(d: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """d with a number, gapless from 0 in each group of within. Rows are numbered in small hashed parts, each after those before it."""
    parts = max(1, min(1 << 16, -(-d.count() // NUMBERED)))
    d = d.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = d.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(*within, "_part", (F.sum("_n").over(Window.partitionBy(*within).orderBy("_part")) - F.col("_n")).alias("_first"))
    at = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) - 1
    return d.withColumn("_at", at).join(first, [*within, "_part"]).withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_part", "_first", "_at")
