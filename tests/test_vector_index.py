import pytest
from conftest import SF
from pyspark.sql import functions as F

from lodestar.operators import vector_index as V
from lodestar.plans import catalogue


def entries(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<double>")


def test_identity_saving_and_snapshots(spark, tmp_path):
    basis = [(str(i), [1.0 if j == i else 0.0 for j in range(4)]) for i in range(4)]
    index = V.VectorIndex(spark, V.Settings(links=1, width=1, bits=99)).add(entries(spark, basis))
    assert (index.settings.links, index.settings.width, index.settings.bits, index.settings.dim) == (2, 10, 8, 4)
    asked = entries(spark, basis).withColumnRenamed("id", "query_id")
    same = lambda x: {(r["query_id"], r["id"]) for r in x.search(asked, 1, exact=True).collect()} == {(str(i), str(i)) for i in range(4)}
    assert same(index)
    index.save(str(tmp_path / "i"))
    loaded = V.VectorIndex.load(spark, str(tmp_path / "i"))
    assert same(loaded) and same(index.clear().restored(index.snapshot()) if index.clear().pivots is not None else loaded.restored(index.snapshot()))
    stats = index.stats().first()
    assert stats["nodes"] == 4 and stats["bytes"] == 4 * 12
    empty = index.clear()
    assert empty.stats().first()["nodes"] == 0 and empty.search(asked).count() == 0


def test_what_an_index_refuses(spark, tmp_path):
    index = V.VectorIndex(spark, V.Settings(most=2)).add(entries(spark, [("a", [1.0, 0.0])]))
    for rows in ([("b", [1.0])], [("a", [0.0, 1.0])], [("b", [1.0, 1.0]), ("b", [1.0, 2.0])], [("b", [1.0, 1.0]), ("c", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            index.add(entries(spark, rows))
    assert index.add(entries(spark, [("b", [0.0, 1.0])])).rows.count() == 2
    spark.createDataFrame([('{"magic": "x"}',)], "head string").write.text(str(tmp_path / "bad/head"))
    with pytest.raises(ValueError):
        V.VectorIndex.load(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_nearest_cells(spark, sf):
    at = SF.replace("0.01", sf)
    exact, near = (catalogue.queries()[n](spark, at).select("query_id", "id", "score") for n in ("index_search_exact", "index_search"))
    hit = near.join(exact.groupBy("query_id").agg(F.min("score").alias("low")), "query_id").filter("score >= low").count()
    assert hit / exact.count() >= 0.9, hit / exact.count()


def test_links_stay_within_bounds(spark):
    rows = [(str(i), [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    index = V.VectorIndex(spark, V.Settings(links=3)).add(entries(spark, rows))
    links = index.links()
    assert index.stats().first()["edges"] == links.count()
    assert links.groupBy("src").count().agg(F.max("count")).first()[0] <= 3
