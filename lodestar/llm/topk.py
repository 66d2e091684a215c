"""Exact top-k inner-product search with ball trees.

Vectors are hashed into shards of about SHARD rows, each in the order of its ball tree, whose
nodes follow from the number of rows. Queries go in blocks through all shards, in waves: in the
first a block visits one shard, in each later one GROWTH times as many as before, every block
others, so that all shards are at work. A task has one shard's tree (centre and radius of its nodes)
and streams the blocks through it, visiting nodes by falling upper bound q.c + |q|r and stopping
below the query's k-th score so far. After a wave that score is raised and goes on with the
queries. What is sent are the vectors once a wave and, for each shard, the queries.

Results are exact: components become floor(64 x), scores are integers. Where sums could leave
the 53 bits of a double they are made of 64-bit, and beyond those of unbounded integers.

Defined results: rows with a null id or vector, or a null or non-finite component, take
no part; shorter vectors count as padded with zeros; a candidate with the query's own id
is the query's own; rows that repeat an id with the same vector count once, and of an id's
different vectors the pair with the highest score counts; equal scores
go to the smaller id; components and scores beyond 64 bits are held at the ends of a long; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tidy

SHARD = 4096
LEAF = 64
BLOCK = 256
#: Shards in a wave, as a multiple of those in the waves before.
GROWTH = 8
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, v: array of floor(scale * x), without the rows that take no part."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & fine)
    return rows.select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")).distinct()


def tree_order(x: np.ndarray) -> np.ndarray:
    """The rows in tree order: halved at the median of the widest axis down to LEAF rows."""
    order, stack = np.arange(len(x)), [(0, len(x))]
    while stack:
        a, b = stack.pop()
        if b - a > LEAF:
            part = x[order[a:b]].astype(float)
            order[a:b] = order[a:b][np.argsort(part[:, int(part.var(0).argmax())], kind="stable")]
            mid = a + (b - a) // 2
            stack += [(a, mid), (mid, b)]
    return order


class BallTree:
    """Nodes over rows in tree order; node i covers rows lo[i]:hi[i]; children by number, -1 for a leaf."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.lo, self.hi, self.left, self.right = [0], [len(ids)], [-1], [-1]
        at = 0
        while at < len(self.lo):
            a, b = self.lo[at], self.hi[at]
            if b - a > LEAF:
                mid = a + (b - a) // 2
                self.left[at], self.right[at] = len(self.lo), len(self.lo) + 1
                self.lo += [a, mid]
                self.hi += [mid, b]
                self.left += [-1, -1]
                self.right += [-1, -1]
            at += 1
        near = x.astype(np.float64)
        self.centre = np.stack([near[a:b].mean(0) for a, b in zip(self.lo, self.hi)])
        self.radius = np.array([np.sqrt(((near[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(self.lo, self.hi, self.centre)])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query (row) and node what no score can exceed, rounding included."""
        q = q.astype(np.float64)
        size = np.sqrt((q * q).sum(1))[:, None]
        reach = np.sqrt((self.centre * self.centre).sum(1))[None, :] + self.radius[None, :]
        return q @ self.centre.T + size * self.radius[None, :] + 1e-3 + 1e-9 * size * reach

    def search(self, own: int, q: np.ndarray, k: int, floor: float, upper: np.ndarray) -> list[tuple[int, int]]:
        """Up to k best (score, -id) of other ids, with a score of at least floor. upper: the bound of each node for q."""
        best: list[tuple[int, int]] = []
        heap = [(-upper[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < (max(floor, best[0][0]) if len(best) == k else floor):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-upper[child], child))
                continue
            a, b = self.lo[node], self.hi[node]
            scores = self.x[a:b] @ q
            least = max(floor, best[0][0]) if len(best) == k else floor
            for i in np.flatnonzero(scores >= least):
                if self.ids[a + i] != own:
                    hit = (int(scores[i]), -int(self.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
        return best


def _kind(top: int, width: int) -> tuple[type, type]:
    """The types in which vectors are sent and in which their products are exact."""
    sent = np.int16 if top < 1 << 15 else np.int64
    return sent, np.float64 if top * top * max(width, 1) < 1 << 53 else np.int64 if top * top * max(width, 1) < 1 << 63 else object


def _waves(shards: int) -> list[int]:
    """How many shards a block has visited after each wave."""
    ends = [1]
    while ends[-1] < shards:
        ends.append(min(shards, ends[-1] * (1 + GROWTH)))
    return ends


_ROW = "part int, kind int, at int, ids binary, v binary, floors binary"


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: rows whose id is divisible by every."""
    x = checkpointed(integers(vectors))
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    n, width = stats["n"], stats["width"] or 1
    sent, exact = _kind(max(abs(stats["high"] or 0), abs(stats["low"] or 0)), width)
    repeats = x.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 1
    held = k * repeats  # a list of so many hits has k different ids
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(n / every / BLOCK))

    def pack(kind: int, at: str):
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["vec_id"].to_numpy(np.int64)
            v = np.zeros((len(ids), width), sent)
            for i, r in enumerate(rows["v"]):
                v[i, : len(r)] = r
            order = np.lexsort((*v.T[::-1], ids))
            if kind == 0:
                order = order[tree_order(v[order])]
            out = {"part": -1, "kind": kind, "at": -1, "ids": ids[order].tobytes(), "v": v[order].tobytes(), "floors": b""}
            return pd.DataFrame([out | {at: int(rows[at].iloc[0])}])

        return one

    # a part has a bounded number of rows: the number of parts grows with the table
    deal = lambda rows, m, seed, at, kind: rows.select(F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(m)).cast("int").alias(at), "vec_id", "v").groupBy(at).applyInPandas(pack(kind, at), _ROW)
    trees = deal(x, shards, 1, "part", 0)
    asked = checkpointed(deal(x.filter(F.col("vec_id") % every == 0), blocks, 2, "at", 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            for r in b.to_pylist():
                ids, v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"], sent).reshape(-1, width).astype(exact)
                if r["kind"] == 0:
                    at, tree = r["part"], BallTree(ids, v)
                    continue
                if at != r["part"]:
                    continue  # a shard without rows
                floors = [f if f > -LONG - 1 else -math.inf for f in np.frombuffer(r["floors"], np.int64).tolist()] or [-math.inf] * len(ids)
                rows = []
                for place, (i, q, f, u) in enumerate(zip(ids.tolist(), v, floors, tree.bounds(v))):
                    rows += [(r["at"], place, i, -h[1], min(LONG, max(-LONG - 1, h[0]))) for h in tree.search(i, q, held, f, u)]
                for a in range(0, len(rows), 10_000):
                    part = list(zip(*rows[a : a + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), *(pa.array(p, pa.int64()) for p in part[2:])], ["at", "place", "query_id", "vec_id", "score"])

    def raised(found: DataFrame) -> DataFrame:
        """The blocks of queries with the scores that hits must reach by now."""
        scores = found.groupBy("at", "place").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("c"))
        few = scores.groupBy("at").agg(F.collect_list(F.struct("place", "low", "c")).alias("known"))  # BLOCK a row

        def set_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                floors = []
                for ids, known in zip(b.column("ids").to_pylist(), b.column("known").to_pylist()):
                    low = np.full(len(ids) // 8, -LONG - 1, np.int64)
                    for p in known or []:
                        if p["c"] >= held:
                            low[p["place"]] = p["low"]
                    floors.append(low.tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "kind", "at", "ids", "v")), pa.array(floors, pa.binary())], ["part", "kind", "at", "ids", "v", "floors"])

        return asked.join(few, "at", "left").select("part", "kind", "at", "ids", "v", "known").mapInArrow(tidy(set_floors), _ROW)

    found, begin, trees = None, 0, checkpointed(trees)
    order = Window.partitionBy("at", "place").orderBy(F.col("score").desc(), "vec_id")
    for end in _waves(shards):
        turn = F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))
        blocks_now = (asked if found is None else raised(found)).select(turn.alias("part"), "kind", "at", "ids", "v", "floors").withColumn("part", ((F.col("part") + F.col("at")) % shards).cast("int"))
        dealt = trees.unionByName(blocks_now).repartition(min(shards, 1 << 15), "part").sortWithinPartitions("part", "kind", "at")
        hits = dealt.mapInArrow(tidy(search), "at int, place int, query_id long, vec_id long, score long")
        hits = hits if found is None else found.unionByName(hits)
        hits = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= held).drop("_n")
        found, begin = checkpointed(hits) if end < shards else hits, end
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
