"""Shuffle files of the steps that are done."""

from lodestar.llm import substring_dedup


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_each_step_deletes_its_own(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "release", lambda _: None)  # garbage collection is not what they wait for
    common = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{i} {common} end{i}") for i in range(60)], "doc_id long, text string")
    before, left = shuffle_files(spark), []
    checkpointed = substring_dedup.checkpointed

    def seen(df):
        left.append(shuffle_files(spark) - before)
        return checkpointed(df)

    monkeypatch.setattr(substring_dedup, "checkpointed", seen)
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(spark, docs).collect()}
    assert out == {i: 40 * (i > 0) for i in range(60)}
    assert left == [set(), set()]
