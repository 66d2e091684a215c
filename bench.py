"""Times of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.

The session and its Python workers are started before the clock is, by a query over no table."""

import json
import os
import time

from lodestar.plans import catalogue
from lodestar.session import local_session

HEADLINE = ["semantic_topk", "hash_embed_buckets", "sq8_quantize", "batch_knn", "sym_substring", "sym_fuzzy", "sym_per_lang_cap", "file_wildcard", "graph_find", "graph_callers", "graph_callees", "chain_downstream", "chain_upstream", "resolved_degree", "pagerank_symbols", "repo_map_files", "scope_assignment", "line_chunks", "content_hash_dedup", "fuse_results", "rerank_pairwise"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(8, numPartitions=8).mapInArrow(lambda batches: batches, "id long").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
