"""Connected components of edges that no single machine needs to hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for nodes that aren't the least, from a task's edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


#: A node with more edges than this, and than one of FREQUENT of all, is a frequent one.
MANY, FREQUENT = 1000, 10_000


def _told(edges: DataFrame, node: str, least: DataFrame, n: int) -> DataFrame:
    """edges (with column other; n in all) joined with least (node, m, c: the node's edges).

    A node with a great many edges would bring all of them to one task. Of those with more than an n / FREQUENT-th there
    are no more than 2 * FREQUENT; their minima are broadcast, and only the other edges are dealt out."""
    often = least.filter(F.col("c") > max(MANY, n // FREQUENT)).select(F.col(node).alias("_node"), F.col("m").alias("_m"))
    met = edges.join(F.broadcast(often), F.col(node) == F.col("_node"), "left")
    rest = met.filter("_node is null").select(node, "other").join(least.select(node, "m"), node)
    return met.filter("_node is not null").select(node, "other", F.col("_m").alias("m")).union(rest.select(node, "other", "m"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b).

    Large-star and small-star rounds: each node hands its larger, then its smaller
    neighbours on to the least of them, until every node points to its root. The number
    of rounds grows with the logarithm of the number of nodes. Minima are pre-aggregated.
    """
    e = checkpointed(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        n = e.count()
        # large star: u's larger neighbours go to the least of u and its neighbours
        both = e.select(F.col("v").alias("x"), F.col("u").alias("other")).union(e.select(F.col("u").alias("x"), F.col("v").alias("other")))
        least = both.groupBy("x").agg(F.min("other").alias("m"), F.count(F.lit(1)).alias("c")).select("x", F.least("x", "m").alias("m"), "c")
        large = _told(both.filter("other > x"), "x", least, n).select(F.col("other").alias("v"), F.col("m").alias("other"))
        # small star: u and its smaller neighbours go to the least of these
        least = large.groupBy("v").agg(F.min("other").alias("m"), F.count(F.lit(1)).alias("c"))
        small = _told(large, "v", least, n).select(F.col("other").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        new = checkpointed(small.filter("v <> u").distinct())
        # done when no root is itself a child and every child has one root: stars, whose centres are their least nodes
        ends = new.select(F.col("v").alias("x"), F.col("u").alias("root")).union(new.select("u", F.lit(None).cast("long")))
        ends = ends.groupBy("x").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("root").alias("c"), F.count(F.lit(1)).alias("all"))
        done = ends.filter("c > 0 and (c < all or a <> b)").isEmpty()
        e = new
        release(e.sparkSession)
        if done:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select("u", F.col("u").alias("root")).distinct())
