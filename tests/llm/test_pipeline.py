import corpus_pipeline
import pytest


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "sentencepiece"]
    assert out.columns == ["doc_id", "n_pieces", "ids"] and 0 < out.select("doc_id").distinct().count() <= n


LONG = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 50_000
ROWS = [(1, None, None, None), (2, "", "en", "s"), (None, "text without an id", "en", "s"), (None, None, None, "s"), (4, LONG, "en", "s"), (5, LONG, "en", "t"), (6, LONG + " more", "en", "t"),
        (7, "one two three four five six", "en", "t"), (7, "one two three four five six", "en", "t"), (8, "b", "fr", None)]


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, _file string, _own int, _row string, _kept int, key string, toxic boolean, _text string, _n int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "f", 2, "r", 3, "k", True, "t", 4) for r in ROWS], schema).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, docs, str(tmp_path))
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "sentencepiece":
        assert out.columns == ["doc_id", "n_pieces", "ids"] and out.count() == len(ROWS)
        return
    rows = out.collect()
    assert out.columns == docs.columns and all(r["_id"] == 1 and r["_n"] == 4 for r in rows)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    if name == "exact_dedup":
        assert kept == [(False, 2), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    elif name == "jaccard_join":
        assert kept == [(False, i) for i in (1, 2, 4, 7, 7, 8)] + [(True, 0), (True, 0)]
    elif name == "toxicity":
        assert len(rows) == len(ROWS)
    else:
        assert {(r["doc_id"], r["text"]) for r in rows} <= {(i, t) for i, t, *_ in ROWS} and rows
