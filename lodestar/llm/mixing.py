"""Mixing sources to target weights, in DataFrame functions only.

A source's target is its weight's share of the wanted total, no more than CAP times its
size; what is above is shared among the others by weight. That ends at
min(CAP * size, level * weight) with one level for all, which running sums over the
sources, ordered by size / weight, give in closed form. rate = target / size; a document
is taken floor(rate) times, and once more where a uniform number hashed from its id, its
source's seed falls below the fraction. Of SEEDS seeds, each source takes
the one that brings its taken words nearest to its target.

Sources may be as many as domains are: they are ranked and summed up in parts, each after those
before it (the number of parts is bounded, see running()).

Defined results: null text has size 0 and is taken by the same rule; a null source is a
source of its own; a source of size 0 has target 0 and takes nothing; an empty table gives
no rows. Rows that repeat an id within a source are taken alike. Other columns, whatever
their names, are kept by mix() and ignored by mixing_plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, small, word_count

WEIGHTS = (5, 2, 1)
SHARE_NUM, SHARE_DEN = 3, 2
CAP = 2
SEEDS = 32


def _key() -> tuple[Column, Column]:
    """Two numbers of 28 bits, from the document's id."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8))


def _uniform(seed: Column | int) -> Column:
    """In [0, 1), from the document's id and the seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return ((F.col("_h1") + seed * F.col("_h2")) % F.lit(1 << 28)) / F.lit(float(1 << 28))


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with, for each name, the sum over the rows before it in order (ties must not be).

    Rows are dealt out by ranges of the order; only the totals of the parts, a row for each, meet in one task."""
    n = partitions(rows.sparkSession)
    dealt = checkpointed(rows.withColumns({f"_by{i}": c for i, c in enumerate(order)}).repartitionByRange(n, *(F.col(f"_by{i}").asc_nulls_last() for i in range(len(order)))).withColumn("_pid", F.spark_partition_id()))
    names = list(sums)
    dealt = dealt.withColumns({f"_v{k}": v for k, v in sums.items()})
    totals = dealt.groupBy("_pid").agg(*(F.sum(f"_v{k}").alias(f"_t{k}") for k in names))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows
    offsets = totals.select("_pid", *(F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in names))
    inside = Window.partitionBy("_pid").orderBy(*(F.col(f"_by{i}").asc_nulls_last() for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({k: F.coalesce(F.sum(f"_v{k}").over(inside), F.lit(0)) for k in names})
    out = out.join(F.broadcast(offsets), "_pid")  # at most n rows
    return out.select(*rows.columns, *((F.col(k) + F.col(f"_o{k}")).alias(k) for k in names))


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): source, source_size, weight, target. One row per source."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_at") % len(WEIGHTS) + 1).cast("int")).cast("long")
    s = running(sizes, [F.col("source")], _at=F.lit(1).cast("long")).withColumn("weight", weight)
    ratio = F.col("source_size") / F.col("weight")
    s = checkpointed(running(s, [ratio, F.col("_at")], _capped=F.col("source_size") * CAP, _before=F.col("weight")))
    all_ = s.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weights"))
    level = (F.col("_size") * SHARE_NUM / SHARE_DEN - F.col("_capped")) / (F.col("_weights") - F.col("_before"))
    s = s.join(F.broadcast(all_)).withColumn("_level", level)  # one row
    # the first source, in this order, that stays under its cap has the level of all that follow
    first = s.filter(F.col("_level") * F.col("weight") <= F.col("source_size") * CAP).agg(F.min_by("_level", F.struct(ratio, F.col("_at"))).alias("_all"))
    s = s.join(F.broadcast(first))  # one row
    full = (F.col("source_size") * CAP).cast("double")
    target = F.when(F.col("_all").isNull() | (F.col("_all") * F.col("weight") > full), full).otherwise(F.col("_all") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def source_rates(d: DataFrame) -> DataFrame:
    """From documents (doc_id, source, size, _h1, _h2): of each source (_s) source_size, target, rate, whole, part and seed."""
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    targets = checkpointed(targets.select(F.col("source").alias("_s"), "source_size", "target", "rate", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part")))
    joined = d.join(small(targets.select("_s", "part")), F.col("source").eqNullSafe(F.col("_s")))
    extra = [F.sum(F.when(_uniform(i) < F.col("part"), F.col("size")).otherwise(0)).alias(f"_e{i}") for i in range(SEEDS)]
    tried = joined.groupBy("source").agg(*extra).select(F.col("source").alias("_t"), *(f"_e{i}" for i in range(SEEDS)))
    gaps = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"_e{i}") - F.col("target")).alias("gap"), F.lit(i).alias("seed")) for i in range(SEEDS)]
    out = targets.join(tried, F.col("_s").eqNullSafe(F.col("_t")))
    return checkpointed(out.select("_s", "source_size", "target", "rate", "whole", "part", F.array_min(F.array(*gaps))["seed"].alias("seed")))


def _copies() -> Column:
    return (F.col("whole") + F.when(_uniform(F.col("seed")) < F.col("part"), 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return checkpointed(d.withColumns(dict(zip(("_h1", "_h2"), _key()))))


def mixing_plan(docs: DataFrame) -> DataFrame:
    """Each document with its copies: doc_id, source, size, source_size, target, rate, copies, taken."""
    d = _sized(docs)
    out = d.join(small(source_rates(d)), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", _copies().alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as many times as the plan takes it.

    A row's copies follow from its id and its source's rate and seed, so texts are joined with the sources only."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, "doc_id", "source")
    rows = rows.withColumns(dict(zip(("_h1", "_h2"), _key())))
    taken = rows.join(small(source_rates(_sized(docs))), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_n", _copies()).filter("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
