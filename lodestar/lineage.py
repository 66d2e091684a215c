"""Cutting long plans by writing to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where none is set in a single machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where := tempfile.mkdtemp(prefix="lodestar-"))
    return where


def cut(df: DataFrame) -> DataFrame:
    """df computed once."""
    shared(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table for a block, after which it is deleted. A table is packed, a checkpoint isn't."""
    spark = df.sparkSession
    at = f"{shared(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    try:
        df.write.parquet(at)
        yield spark.read.schema(df.schema).parquet(at)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
