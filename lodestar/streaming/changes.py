"""Incremental maintenance: a batch of changes, or a stream of batches, applied to an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touched(changes: DataFrame) -> DataFrame:
    """path of every file whose rows go: changed, deleted, and both ends of a renaming."""
    return changes.select(F.explode(F.filter(F.array("path", "old_path"), lambda p: p.isNotNull())).alias("file")).distinct()


def reindexed(changes: DataFrame) -> DataFrame:
    return changes.filter("status <> 'D'").select(F.col("path").alias("file")).distinct()


def apply(refs: DataFrame, changes: DataFrame, new_rows: DataFrame) -> DataFrame:
    """refs without the touched files' rows, and the new rows of files that are not deleted."""
    kept = refs.join(touched(changes), "file", "left_anti")
    added = new_rows.join(reindexed(changes), "file", "left_semi")
    return kept.select(*refs.columns).unionByName(added.select(*refs.columns))


def missing_chunks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks, once per language and content, that aren't stored."""
    return new.dropDuplicates(["lang", "content_hash"]).join(stored.select("lang", "content_hash"), ["lang", "content_hash"], "left_anti")


def follow(changes: DataFrame, apply_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that hands each micro-batch of changes to apply_batch once."""
    return changes.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
