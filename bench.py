"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs
once to warm up and once timed, with its whole result computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "user_top_k", "user_profile", "review_feedback", "user_feedback_rate", "category_user_map",
    "top_business_categories", "feature_rows", "pair_affinity", "embedding_pool_mean", "city_matrix",
    "similar_businesses", "jaccard_exact", "embedding_top_k", "cosine_by_category", "random_negatives",
    "nearest_negatives", "ndcg_at_k", "rmse_by_cluster", "error_by_star", "star_confusion", "stratified_split",
    "duplicate_keys", "text_embed", "als_fit", "user_clusters", "rating_regressor",
]


def main() -> None:
    from affinia.plans import QUERIES
    from affinia.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus, name="bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
        print(f"{times[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total after one warm-up each",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
