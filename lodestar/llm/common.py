"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. None set: a local one where all run in one machine, as in tests; else refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df computed once into a table of the shared folder, and its path, for the caller to remove when nothing needs it any more."""
    at = scratch(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of frames that are no longer referenced."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage, after which they hand free heap and buffers outside of it back.

    A heap that one job has grown else stays so beside the Python workers of the next. A task for each core reaches every idle executor."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def tidy(run: Callable, *forget: Callable) -> Callable:
    """run, a function over Arrow batches, that hands its memory back to the system when a task is through with it.

    Python workers outlive their tasks, and what their allocators keep would add up beside the JVM's heap."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            trim()

    return whole


def trim() -> None:
    """Hand what allocators keep back to the system."""
    with contextlib.suppress(Exception):
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df, marked for broadcasting if it has no more than so many rows; else the join deals both sides out. df: computed before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def marked(rows: DataFrame, keys: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """rows with maybe: whether column may be among the column of that name of keys, never false where it is.

    A bitmap of 2 ** bits bits (2 MB for 24) is broadcast at any number of keys. Where it fills up more rows are marked."""
    place = F.pmod(F.xxhash64(column), F.lit(1 << bits)) + 1  # the bitmap functions count from 1
    found = keys.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    placed = rows.withColumn("_p", place).withColumn("_at", F.bitmap_bit_position("_p").cast("int"))
    joined = placed.join(F.broadcast(found), F.bitmap_bucket_number("_p") == F.col("_part"), "left")
    octet = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.select(*rows.columns, F.coalesce(F.getbit(octet, F.col("_at") % 8) == 1, F.lit(False)).alias("maybe"))


def unused(columns: list[str], *names: str) -> list[str]:
    """For each name one that isn't among columns in any case, so that helper columns never clash with the input's."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for a block; keys use '__' for '.'."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(n: int) -> list[int]:
    """For each of n partitions, an int that Spark's hash partitioning deals to it: so each gets one bucket."""
    import numpy as np

    k = np.arange(64 * n + 64, dtype=np.uint32)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.uint32(42) ^ turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    at = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
    places, first = np.unique(at, return_index=True)
    keys = dict(zip(places.tolist(), first.tolist()))
    return [keys.get(p, p) for p in range(n)]


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
