"""What queries send and hold on inputs where pairs are many more than rows."""

import pytest
from conftest import SF, TABLES, against_oracle

from lodestar.plans import catalogue


def figures(spark, run):
    """Records that run's stages sent to others, and its result."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
    total = lambda s: sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))
    before = total(stages())
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total(stages()) - before, out


@pytest.fixture(scope="module")
def one_name(spark, tmp_path_factory):
    """Tables of 600 parts of one name, each of which calls the next one, some themselves."""
    at = tmp_path_factory.mktemp("one-name")
    for t in TABLES:
        if t not in ("part", "lineitem"):
            (at / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    n = 600
    part = spark.range(n).selectExpr("id AS p_partkey", "'red' AS p_name", "concat('Brand#', id % 3) AS p_brand", "'kind' AS p_type", "if(id % 100 = 7, 2, 1) AS p_size", "1.0D AS p_retailprice")
    part.withColumn("p_brand", part.p_brand.substr(1, 6)).coalesce(1).write.parquet(str(at / "part.parquet"))
    line = spark.range(2 * n).selectExpr("id div 2 AS l_orderkey", f"(id div 2 + id % 2) % {n} AS l_partkey", "1L AS l_suppkey", "cast(id % 2 AS int) + 1 AS l_linenumber", "1.0D AS l_extendedprice")
    line.coalesce(1).write.parquet(str(at / "lineitem.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["resolved_degree", "pagerank_symbols", "repo_map", "repo_map_files", "repo_map_text", "repo_map_top_symbols"])
def test_a_common_name_makes_no_pairs(spark, one_name, name):
    sent, got = figures(spark, lambda: catalogue.queries()[name](spark, one_name).localCheckpoint())
    assert sent < 60_000  # 600 x 600 pairs are 360,000
    against_oracle(got, catalogue.oracle_sql()[name], one_name)


def test_ranks_of_a_larger_scale(spark):
    sf = SF.replace("0.01", "0.1")
    for name in ("resolved_degree", "pagerank_symbols"):
        against_oracle(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], sf)


def test_vectors_meet_in_blocks(spark):
    """An exact search of 2,000 vectors by 100 queries isn't a row a pair, and a vector that is very common fills no list by chance."""
    from pyspark.sql import functions as F

    from lodestar.operators import vector_index as V

    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5))).otherwise(F.array(F.cos("id"), F.sin("id"), F.lit(0.5))).alias("vector"))
    index = V.VectorIndex(spark).add(rows)
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = index.search(asked, 10, exact=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "MapInArrow" in plan
    want = sorted(map(str, range(0, 2000, 2)))[:10]
    assert all([r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == want and rows[0]["score"] == 1.0 for rows in ([r for r in found.collect() if r["query_id"] == q] for q in ("0", "20", "1980")))


@pytest.mark.parametrize("name, pairs", [("related_chunks_bfs", 594), ("chain_downstream", 600 * 594), ("chain_upstream", 0)])
def test_steps_of_a_common_name_are_not_sent(spark, one_name, name, pairs):
    """Of a first step at least pairs are in the result; 600 parts have one name, all but 6 one language."""
    sent, n = figures(spark, lambda: catalogue.queries()[name](spark, one_name).count())
    assert sent < 60_000 and n >= pairs * 0.9


@pytest.mark.parametrize("name", ["chunk_calls", "related_chunks"])
def test_pairs_of_chunks_are_not_sent(spark, name):
    sent, got = figures(spark, lambda: catalogue.queries()[name](spark, SF).localCheckpoint())
    assert sent < 250_000
    against_oracle(got, catalogue.oracle_sql()[name])


def test_texts_of_many_candidates_stay(spark):
    """Of 40 partitions' candidates only the texts of the first rows go to the task that orders them, and repeats of a row stay."""
    from pyspark.sql import functions as F

    from lodestar.operators import retrieval as R

    rows = spark.range(4000, numPartitions=40).select(F.element_at(F.array(*map(F.lit, R.SOURCES)), (F.col("id") % 3 + 1).cast("int")).alias("source"), (F.col("id") - F.when(F.col("id") == 3999, 3).otherwise(0)).alias("id"), (F.col("id") - F.when(F.col("id") == 3999, 3).otherwise(0)).cast("double").alias("score"), F.col("id").cast("string").alias("text"))
    got = R.fuse(rows, {"vector": 0.5, "graph": 0.5, "symbol": 0.5}, 50)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("GlobalLimit") == 2
    found = got.collect()
    assert len(found) == 50 and {"3996", "3999"} <= {r["text"] for r in found}


def test_texts_are_summed_where_they_are_made(spark):
    sent, got = figures(spark, lambda: catalogue.queries()["symbolic_embed"](spark, SF).collect())
    assert sent <= 2000 < len(got)
