"""Registered queries against their SQL at the smallest scale, and plan shapes.

A sample of every group by default; AFFINIA_ALL=1 compares all of them.
"""

import os

import pytest

import __spark_entry__ as entry_points
from affinia.plans import ORACLES, QUERIES
from compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "user_profile", "review_feedback", "category_tokens", "haversine_distance", "user_top_k", "id_index", "reverse_index",
    "implicit_ratings", "feature_rows", "anti_join_negatives", "category_user_map", "top_business_categories",
    "embedding_pool_mean", "cluster_profile", "score_summary", "stratified_split", "duplicate_keys", "key_uniqueness",
    "pair_affinity", "similar_businesses", "jaccard_exact", "embedding_top_k", "cosine_by_category", "standard_scale",
    "text_embed", "important_cities", "random_negatives", "category_negatives", "nearest_negatives", "ndcg_at_k",
    "contrastive_loss", "rmse_by_cluster", "feature_box_stats", "prediction_histogram", "read_jsonl", "write_similar_pairs",
    "lsh_candidates", "pca_2d", "assemble_features", "text_idf",
]
NAMES = list(ORACLES) if os.environ.get("AFFINIA_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["user_id", "business_id", "n", "rank", "affinity"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", [
    "feature_rows", "category_user_map", "similar_businesses", "jaccard_exact", "nearest_negatives", "random_negatives",
    "anti_join_negatives", "embedding_top_k", "cosine_matrix", "all_pairs_affinity", "als_top_k",
])
def test_no_nested_loop_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = QUERIES["user_top_k"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = QUERIES["interaction_counts"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), Not(EqualTo(l_returnflag,N))" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_returnflag:string>" in plan
