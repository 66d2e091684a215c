"""What executors hold after a stage."""

import glob
import os

import corpus_pipeline
from lodestar.llm import exact_dedup


def open_databases(spark) -> int:
    """RocksDB holds its LOCK file open as long as a database is."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    return sum(os.path.basename(os.readlink(f)) == "LOCK" for f in glob.glob(f"/proc/{pid}/fd/*") if os.path.lexists(f))


def test_state_is_closed(spark):
    before = open_databases(spark)
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    kept = exact_dedup.dedup(spark, docs)
    assert open_databases(spark) <= before
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(150, 200))


def test_stages_begin_with_a_collection(spark):
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    for name, stage in corpus_pipeline.STAGES:
        if name == "sentencepiece":  # no job of its own before its frame is asked for
            docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
            before = full()
            stage(spark, docs, "")
            assert full() > before
