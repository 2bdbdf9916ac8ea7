"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from sparkloom import queries as engine
from sparkloom.session import local_session, ship_package

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["tokenize_index", "normalize_rows", "doc_frequency_idf", "shard_keywords_tfidf", "bm25_topk", "bm25_per_shard", "dense_topk", "hybrid_rrf_global", "shard_sparse_cosine", "term_graph", "centroids", "coherence", "ranking_metrics_at_10", "judge_overlap"]
DATA = ["op1_language", "op2_simhash", "op3_exact_dedup", "op4_packing", "op5_neighbours", "op6_toxicity", "op7_mixing", "op8_html", "op9_chat", "op10_quality"]


def main() -> None:
    spark = local_session("bench", CPUS, max(8, int(CPUS) if CPUS.isdigit() else 8), "8g")
    ship_package(spark)
    runs = {n: engine.QUERIES[n] for n in HEADLINE}
    try:
        from sparkloom.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    runs |= {n: QUERIES[n] for n in DATA if n in QUERIES}
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, run in runs.items():
        began = time.time()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
