"""Queries read their whole tables: every row that can be in a result is in it."""

from conftest import SF
from pyspark.sql import functions as F

from lodestar.operators import search as S
from lodestar.plans import catalogue, roles


def test_the_stated_queries_meet_every_embedding(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = catalogue.queries()["batch_knn"](spark, SF)
    assert found.select("query_id").distinct().count() == n.filter("vec_id % 50 = 0").count() and found.filter("item_id >= 100").count() > 0


def test_pairs_of_several_blocks(spark):
    items = spark.range(2500).select("id", F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("v"))
    got = S.top_k_pairs(items, items, 3).filter("rank = 1").agg(F.count(F.lit(1)), F.min("score")).first()
    assert got[0] == 2500 and got[1] > 0.99


def test_every_document_is_a_candidate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert catalogue.queries()["rerank_min_max"](spark, SF).count() == docs.count()
    for name in ("fuse_results", "rerank_pairwise"):
        assert catalogue.queries()[name](spark, SF).filter("id >= 90").count() > 0


def test_every_symbol_has_a_rank(spark):
    sf = SF.replace("0.01", "0.1")
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    ranks = catalogue.queries()["pagerank_symbols"](spark, sf)
    assert ranks.count() == ranks.select("ref_id").distinct().count() == n > 5000


def test_every_line_calls(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").groupBy("l_orderkey").count().agg(F.sum(F.col("count") - 1)).first()[0]
    g = roles.graph(spark, SF)
    assert 0.9 * n < g.call.count() <= n and g.ref.count() == g.call.count()
