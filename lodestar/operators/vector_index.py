"""A vector index: quantised vectors in a table, links to near neighbours, and a search over both.

The table is cut into cells around sampled pivots; a vector lives with its nearest pivot. A search looks at
the nearest cells of each query, or at all of them, which is exact. Adding, saving and snapshots
keep to the same checks: one width, no id twice, no more than the index may hold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..lineage import cut

MAGIC, VERSION = "lodestar-vectors", 1
#: Pivots at most: they go to every task.
PIVOTS = 4096


@dataclass(frozen=True)
class Settings:
    """links: neighbours of a vector; width: of 64 cells, those that a search looks at; bits of a code; most: vectors that it may hold."""

    links: int = 16
    width: int = 48
    bits: int = 8
    dim: int | None = None
    most: int = 1 << 40

    def held(self) -> Settings:
        """Within bounds: 2 links, a width of 10, 4 to 8 bits at least."""
        return replace(self, links=max(2, self.links), width=max(10, self.width), bits=min(8, max(4, self.bits)))


SCHEMA = "id string, lang string, cell int, scale double, codes array<int>"


class VectorIndex:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, rows: DataFrame | None = None, pivots: np.ndarray | None = None):
        self.spark, self.settings = spark, (settings or Settings()).held()
        self.rows = rows if rows is not None else spark.createDataFrame([], SCHEMA)
        self.pivots = pivots

    # -- adding

    def add(self, entries: DataFrame) -> VectorIndex:
        """The index with entries (id, vector, and lang if there is one). Raises ValueError for an id that repeats, another width, or too many."""
        entries = entries.select(F.col("id").cast("string").alias("id"), "vector", (F.col("lang") if "lang" in entries.columns else F.lit("")).alias("lang"))
        facts = entries.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        if not facts["n"]:
            return self
        dim = self.settings.dim or facts["high"]
        if facts["low"] != dim or facts["high"] != dim:
            raise ValueError(f"vectors of width {dim} expected, found {facts['low']} to {facts['high']}")
        if facts["ids"] != facts["n"] or not entries.join(self.rows.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("an id is in the index already")
        if facts["n"] + self.rows.count() > self.settings.most:
            raise ValueError(f"the index holds {self.settings.most} vectors at most")
        pivots = self.pivots if self.pivots is not None else self._drawn(entries, facts["n"])
        coded = entries.withColumn("q", V.quantise(F.col("vector"), self.settings.bits))
        placed = coded.select("id", "lang", _cells(F.col("q.q"), pivots, 1)[0].alias("cell"), F.col("q.scale").alias("scale"), F.col("q.q").alias("codes"))
        return VectorIndex(self.spark, replace(self.settings, dim=dim), cut(self.rows.unionByName(placed)), pivots)

    def _drawn(self, entries: DataFrame, n: int) -> np.ndarray:
        """About the square root of n vectors, PIVOTS at most, by a hash of the id."""
        wanted = min(PIVOTS, max(1, math.isqrt(n)))
        few = entries.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").collect()
        p = np.array([r["vector"] for r in few], float)
        size = np.sqrt((p * p).sum(1, keepdims=True))
        return p / np.where(size == 0, 1, size)

    # -- searching

    def search(self, queries: DataFrame, k: int = 10, lang: str | None = None, exact: bool = False) -> DataFrame:
        """query_id, id, score (cosine), rank: for each query (query_id, vector) the k best of the nearest cells, width in 64 of them; exact: of all.

        Blocks of queries and of cells meet by the cell, so each vector is compared with the queries that ask for its cell only."""
        if self.settings.dim is None:
            return self.spark.createDataFrame([], "query_id string, id string, score double, rank int")
        rows = self.rows if lang is None else self.rows.filter(F.col("lang") == lang)
        n = len(self.pivots)
        probes = n if exact else max(1, -(-n * min(64, self.settings.width) // 64))
        q = queries.select("query_id", V.quantise(F.col("vector"), self.settings.bits)["q"].alias("q"))
        scored = _scored(rows, q.withColumn("cells", _cells(F.col("q"), self.pivots, probes)), k)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def links(self) -> DataFrame:
        """src, dst, score: each vector's nearest ones of its cell, at most as many as the settings say. All vectors of a cell are
        compared, so the work grows with the cells' sizes; searching doesn't need it."""
        a = self.rows.select("cell", F.col("id").alias("src"), F.col("codes").alias("a"))
        b = self.rows.select("cell", F.col("id").alias("dst"), F.col("codes").alias("b"))
        scored = a.join(b, "cell").filter("src <> dst").select("src", "dst", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("score"))
        return pruned(scored, self.settings.links)

    # -- keeping

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        head = {"magic": MAGIC, "version": VERSION, "settings": self.settings.__dict__, "n": self.rows.count(), "pivots": None if self.pivots is None else self.pivots.tolist()}
        self.spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        if head.get("magic") != MAGIC:
            raise ValueError("not a vector index")
        if head.get("version") != VERSION:
            raise ValueError(f"version {head.get('version')} of a vector index, {VERSION} expected")
        rows = spark.read.schema(SCHEMA).parquet(f"{path}/rows")
        if rows.count() != head["n"]:
            raise ValueError(f"{head['n']} vectors expected, found {rows.count()}")
        return cls(spark, Settings(**head["settings"]), rows, None if head["pivots"] is None else np.array(head["pivots"], float))

    def snapshot(self) -> DataFrame:
        """json: a row a vector."""
        return self.rows.select(F.to_json(F.struct(*self.rows.columns)).alias("json"))

    def restored(self, snapshot: DataFrame) -> VectorIndex:
        """An index of these settings and pivots with a snapshot's vectors."""
        rows = snapshot.select(F.from_json("json", SCHEMA).alias("r")).select("r.*")
        return VectorIndex(self.spark, self.settings, cut(rows), self.pivots)

    def stats(self) -> DataFrame:
        """nodes, edges, cells, levels, bytes of codes."""
        cells = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("codes") + 8).alias("size"))
        edges = F.col("n") * F.least(F.lit(self.settings.links), F.col("n") - 1)  # as links() has them
        size = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum(edges), F.lit(0)).alias("edges"), F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        return size.select("nodes", "edges", "cells", F.when(F.col("nodes") > 0, 2).otherwise(0).alias("levels"), "bytes")

    def clear(self) -> VectorIndex:
        return VectorIndex(self.spark, replace(self.settings, dim=None))


def pruned(scored: DataFrame, most: int) -> DataFrame:
    """Of scored pairs (src, dst, score) the most best ones of each src."""
    best = Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    return scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most).drop("_n")


def _cells(codes: Column, pivots: np.ndarray, most: int) -> Column:
    """array<int>: the most nearest pivots, by the direction of codes; the smaller number first where equal."""
    @F.pandas_udf("array<int>")
    def nearest(batch: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in batch]) if len(batch) else np.zeros((0, pivots.shape[1]))
        near = (x @ pivots.T).round(6)
        order = near.argmax(1)[:, None] if most == 1 and len(x) else np.argsort(-near, axis=1, kind="stable")[:, :most]
        return pd.Series(list(order.astype(np.int32)))

    return nearest(codes)


#: Rows of a block of vectors or queries.
BLOCK = 1024


def _scored(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of rows (cell, id, codes) and the queries (query_id, q, cells) that ask for their cell: the k best of each query and
    no more than a task must keep, as it can't tell yet.

    Blocks of rows and of queries meet by the cell, and are dealt out by the pair: its scores are one product of matrices."""
    sizes = rows.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("parts"))
    placed = rows.join(F.broadcast(sizes), "cell")  # a row a pivot
    packed = placed.select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "codes").groupBy("cell", "part").applyInPandas(_packed, "cell int, part long, ids array<string>, codes binary")
    n = max(1, -(-queries.count() // BLOCK))
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("asking"), "query_id", "q", "cells").groupBy("asking").applyInPandas(_asking, "cell int, asking long, query_ids array<string>, q binary")
    pairs = packed.join(asked, "cell").repartition("asking", F.pmod(F.xxhash64("cell", "part"), F.lit(64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}  # of a query the k best scores so far
        for batch in batches:
            for r in batch.to_pylist():
                x, q = (np.frombuffer(r[c], np.int8).reshape(len(r[i]), -1).astype(float) for c, i in (("codes", "ids"), ("q", "query_ids")))
                micro = _micro(q, x)
                # ids of a block are in order, so of equal scores the first one is the smaller id
                key = micro * (1 << 32) - np.arange(len(x))
                best = np.argpartition(-key, k - 1, axis=1)[:, :k] if len(x) > k else np.broadcast_to(np.arange(len(x)), micro.shape)
                out: list[tuple[str, str, float]] = []
                for i, query in enumerate(r["query_ids"]):
                    mine = micro[i, best[i]]
                    seen = np.concatenate([known[query], mine]) if query in known else mine
                    known[query] = seen = np.sort(seen)[-k:]
                    low = seen[0] if len(seen) == k else -(1 << 60)
                    out += [(query, r["ids"][j], int(m) / 1e6) for j, m in zip(best[i], mine) if m >= low]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["query_id", "id", "score"])
            if len(known) > 100_000:
                known.clear()

    return pairs.mapInArrow(search, "query_id string, id string, score double")


def _packed(b: pd.DataFrame) -> pd.DataFrame:
    order = sorted(range(len(b)), key=b["id"].tolist().__getitem__)
    return pd.DataFrame({"cell": [b["cell"].iloc[0]], "part": [b["part"].iloc[0]], "ids": [[b["id"].iloc[i] for i in order]], "codes": [np.stack(b["codes"].to_numpy())[order].astype(np.int8).tobytes()]})


def _asking(b: pd.DataFrame) -> pd.DataFrame:
    """A row for each cell that queries of a block ask for."""
    q, ids = np.stack(b["q"].to_numpy()).astype(np.int8), b["query_id"].astype(str).to_numpy()
    cells = np.stack(b["cells"].to_numpy())
    at = np.repeat(np.arange(len(b)), cells.shape[1])
    order = np.argsort(cells.ravel(), kind="stable")
    found, first = np.unique(cells.ravel()[order], return_index=True)
    members = np.split(at[order], first[1:])
    return pd.DataFrame({"cell": found.astype(np.int32), "asking": [b["asking"].iloc[0]] * len(found), "query_ids": [ids[m].tolist() for m in members], "q": [q[m].tobytes() for m in members]})


def _micro(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows in millionths, as whole numbers; halves go away from 0, by the shortest decimal that means the number, as Spark's round has it."""
    size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
    s = np.divide(q @ x.T, size, out=np.zeros_like(size), where=size != 0)
    scaled = np.abs(s) * 1e6
    low = np.floor(scaled)
    micro = (low + (scaled - low >= 0.5)).astype(np.int64)
    for i, j in np.argwhere(np.abs(scaled - low - 0.5) < 1e-6):
        micro[i, j] = int(Decimal(repr(float(abs(s[i, j])))).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return np.where(s < 0, -micro, micro)
