"""Exact deduplication with streaming state, in DataFrame functions only.

The documents stream through an aggregation whose state, in RocksDB on disk and without
expiry, holds for each digest the number of its rows and the identifier and locator (file,
row) of the row that stays. Hits, that is digests of several rows, are then held against
the full bytes: a fixed-size bitmap of the hits keeps other texts out, and the texts of a
digest must be one text. Should two texts ever share a digest, the state is built anew
with the text itself as its key. The state can be kept in a folder of the caller's; a later
run over the same folder with more files then reads only the new ones into it.

Defined results: a null text is the empty text; of equal texts the row with the largest
doc_id stays (of rows that repeat that id, the one with the last locator, so exactly one
stays; a null id is the smallest); an empty table gives no rows. Other columns, whatever
their names, are ignored by dedup_classes() and kept by dedup().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, marked, remove, scratch, settings, unused

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State memory of an executor that lies outside of its heap; the rest of the state is on disk.
STATE_MB = 64
#: Each partition's database is closed by the task that commits it. Else all stay open, with native memory that STATE_MB
#: doesn't bound, until a maintenance round a minute later: on check_h 80 MB of each executor for each run.
UNLOAD = "spark__sql__streaming__stateStore__unloadOnCommit"
#: Bits of the hits' bitmap: 2 MB. Where it fills up more texts are compared, with the same result.
HIT_BITS = 24


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(frame: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return frame.select(F.col("doc_id"), text.alias("text"), digest(text).alias("key"), *_place(frame, "file", "row"))


def _place(frame: DataFrame, file: str, row: str) -> list[Column]:
    """Where Spark read a row: the hidden column, also beside one of the data with its name."""
    at = frame.metadataColumn("_metadata")
    return [at["file_path"].alias(file), at["row_index"].alias(row)]


def _stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files of a folder, or of a single file, which streams read by its folder and name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def _state(spark: SparkSession, path: str, schema, digest: Callable[[Column], Column], kept_in: str | None) -> DataFrame:
    """key, keep_id, keep_file, keep_row, group_size: what the state holds after the last batch."""
    at = kept_in or scratch(spark, "exact-dedup")
    conf = {"spark__sql__streaming__stateStore__providerClass": ROCKSDB, "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true", "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": str(STATE_MB), "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false", "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true", UNLOAD: "true"}
    try:
        with settings(spark, **conf):
            stream = _rows(_stream(spark, path, schema), digest)
            held = stream.groupBy("key").agg(F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
            query = held.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", at).start()
            query.awaitTermination()
            stored = spark.read.format("statestore").load(at)
            stays, n = (F.col("value").getField(f.name) for f in stored.schema["value"].dataType.fields)
            return checkpointed(stored.select(F.col("key.key").alias("key"), stays["doc_id"].alias("keep_id"), stays["file"].alias("keep_file"), stays["row"].alias("keep_row"), n.alias("group_size")))
    finally:
        if not kept_in:
            remove(spark, at)


def _located(spark: SparkSession, docs: DataFrame | str) -> tuple[str, DataFrame, bool]:
    """A folder that Spark can stream, its batch frame, and whether it was written here, as frames that aren't a plain read are."""
    if isinstance(docs, str):
        return docs, spark.read.parquet(docs), False
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        files = docs.inputFiles()
        folders = {f.rpartition("/")[0] for f in files}
        if len(files) == 1:
            return files[0], spark.read.parquet(files[0]), False
        if len(folders) == 1:
            folder = folders.pop()
            whole = spark.read.parquet(folder)
            if len(whole.inputFiles()) == len(files):
                return folder, whole, False
    at = scratch(spark, "documents")
    docs.write.parquet(at)
    return at, spark.read.parquet(at), True


def dedup_classes(spark: SparkSession, docs: DataFrame | str, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per document: doc_id, text_sha256, keep_id, group_size, kept, file, row. docs: a frame or a Parquet path.

    state: a folder in which the state stays; only then later runs go on from it."""
    path, batch, written = _located(spark, docs)
    return _done(spark, _classes(spark, path, batch, digest, state), path, written)


def _done(spark: SparkSession, out: DataFrame, path: str, written: bool) -> DataFrame:
    """out; where its input was written here, out is computed and the input deleted."""
    if written:
        out = checkpointed(out)
        remove(spark, path)
    return out


def _classes(spark: SparkSession, path: str, batch: DataFrame, digest: Callable[[Column], Column], kept_in: str | None = None) -> DataFrame:
    if not batch.inputFiles():
        return spark.createDataFrame([], "doc_id long, text_sha256 string, keep_id long, group_size long, kept boolean, file string, row long")
    state = _state(spark, path, batch.schema, digest, kept_in)
    rows = _rows(batch, digest)
    # full bytes: grouping compares them; each task sends a text once
    texts = marked(rows, state.filter("group_size > 1"), "key", HIT_BITS).filter("maybe").groupBy("key", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    if not texts.filter("texts > 1").isEmpty():
        return _classes(spark, path, batch, lambda text: text)
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    rows = rows.withColumn("text_sha256", sha256(F.col("text"))).drop("text")
    return rows.join(state, "key").select("doc_id", "text_sha256", "keep_id", "group_size", stays.alias("kept"), "file", "row")


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all of their columns."""
    path, batch, written = _located(spark, docs)
    file, row = unused(batch.columns, "_file", "_row")
    kept = _classes(spark, path, batch, sha256).filter("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    placed = batch.select(*batch.columns, *_place(batch, file, row))
    return _done(spark, placed.join(kept, [file, row], "left_semi").select(*docs.columns), path, written)
