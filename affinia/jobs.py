"""The batch jobs: rating prediction, ranking, business similarity, factorization search, and scoring a result.

    python -m affinia.jobs rating   DATA_DIR TRAIN_PAIRS[,VALIDATION_PAIRS] TEST_PAIRS OUT
    python -m affinia.jobs ranking  DATA_DIR TRAIN_PAIRS[,VALIDATION_PAIRS] TEST_PAIRS OUT [K]
    python -m affinia.jobs similar  PAIRS OUT [THRESHOLD]
    python -m affinia.jobs tune     TIPS OUT
    python -m affinia.jobs rmse     TRUTH PREDICTIONS

DATA_DIR holds user.json, business.json, review_train.json and tip.json, one
record per line, and TIPS is such a tip file; pair files are CSV with a header. For
ranking it may also hold photo.json and photo_vectors.parquet (photo_id, embedding).
A job deletes its intermediate tables when it ends.
"""

from __future__ import annotations

import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.functions.scalars import hash32
from affinia.operators import blocks, evaluation, factors, models, ranking, retrieval, segments, similarity, transforms
from affinia.operators.aggregates import avg_useful, feedback, pool
from affinia.operators.interactions import (
    implicit_ratings, index_ids, interaction_counts, label_encode,
)
from affinia.operators.joins import attach_cluster, feature_rows
from affinia.operators.profiles import transform_businesses, transform_reviews, transform_users
from affinia.operators.transforms import city_matrix
from affinia.session import materialise, release, tune
from affinia.sources import files, schemas


class RatingData:
    """Derived tables of one data folder, each written once for the steps that share it."""

    def __init__(self, spark: SparkSession, data_dir: str, als_settings: dict | None = None, clusters: int = segments.CLUSTERS):
        def read(name: str, schema) -> DataFrame:
            return files.read_jsonl(spark, os.path.join(data_dir, name), schema)

        reviews = materialise(transform_reviews(read("review_train.json", schemas.REVIEWS)), "reviews")
        places = transform_businesses(read("business.json", schemas.BUSINESSES))
        self.users = materialise(feedback(transform_users(read("user.json", schemas.USERS)), reviews, "user_id"), "users")
        self.businesses = materialise(
            label_encode(places, "city").join(avg_useful(reviews), "business_id", "left"), "businesses"
        )
        # users are grouped by the cities of the businesses with a category they reviewed
        visited = reviews.select("user_id", "business_id").distinct()
        self.clusters = materialise(
            segments.user_clusters(city_matrix(visited, self.businesses.where("categories is not null")), clusters), "clusters"
        )
        counts = materialise(interaction_counts(read("tip.json", schemas.TIPS)), "counts")
        user_index, business_index = index_ids(counts, "user_id"), index_ids(counts, "business_id")
        model = factors.fit_als(implicit_ratings(counts, user_index, business_index), **(als_settings or {}))
        self.user_vectors, self.business_vectors = (
            materialise(v, "factors") for v in factors.factors(model, user_index, business_index)
        )

    def features(self, pairs: DataFrame) -> DataFrame:
        """Feature rows of a pair file, with the cluster of the user."""
        scores = factors.score_pairs(pairs, self.user_vectors, self.business_vectors)
        rows = feature_rows(pairs, scores, self.users, self.businesses)
        return materialise(attach_cluster(rows, self.clusters), "features")


NOT_FEATURES = ("user_id", "business_id", "stars", "Cluster", "score_source")


def rating_job(
    spark: SparkSession, data_dir: str, train_path: str, test_path: str, out_path: str,
    als_settings: dict | None = None, clusters: int = segments.CLUSTERS, tier_params: dict | None = None,
    cluster_params: dict[int, dict] | None = None,
) -> DataFrame:
    """Predict the pairs of the test file and write them as CSV.

    `train_path` may name several pair files, separated by commas; all of them are
    learned from. Columns left out per cluster are written to OUT-dropped.
    """
    data = RatingData(spark, data_dir, als_settings, clusters)
    pairs = reduce(files.combine_pairs, [files.read_csv(spark, path, schemas.PAIRS) for path in train_path.split(",")])
    train = data.features(pairs)
    test = data.features(files.read_csv(spark, test_path, schemas.PAIRS))
    names = [c for c in train.columns if c not in NOT_FEATURES]
    sizes = segments.size_tiers(train.where(F.col("Cluster").isNotNull())).collect()  # one row per cluster
    tiers = {row["Cluster"]: row["tier"] for row in sizes}
    fitted = models.fit_by_cluster(train, names, tiers, tier_params=tier_params, cluster_params=cluster_params)
    files.write_csv(models.dropped_columns(fitted, spark), f"{out_path}-dropped", "Cluster", "column_name")
    predictions = models.predict_clip(fitted, test).select("user_id", "business_id", "prediction")
    files.write_csv(predictions, out_path)
    return files.read_csv(spark, out_path, schemas.PREDICTIONS)


PHOTO_DIM = 64


def _photo_vectors(spark: SparkSession, data_dir: str) -> DataFrame:
    """(business_id, features): mean photo vector, from the two optional photo files."""
    photos, vectors = os.path.join(data_dir, "photo.json"), os.path.join(data_dir, "photo_vectors.parquet")
    if not (files.exists(spark, photos) and files.exists(spark, vectors)):
        return spark.createDataFrame([], "business_id string, features array<double>")
    table = transforms.image_table(files.read_jsonl(spark, photos, schemas.PHOTOS), files.read_table(spark, vectors), PHOTO_DIM)
    return pool(table, "business_id", "embedding", PHOTO_DIM)


def ranking_job(spark: SparkSession, data_dir: str, train_path: str, test_path: str, out_path: str, k: int = 10) -> DataFrame:
    """Recommend k businesses to every user of the test file, and measure where the pairs of that file rank.

    Businesses get block vectors of their numbers, categories, review texts and photos. Two thirds of the
    training pairs are the users' histories, which make their profiles; the rest, against the nearest
    unvisited businesses, weighs the parts. Writes OUT (user, business, score, rank), OUT-metrics,
    OUT-layout and OUT-weights as CSV.
    """
    places = materialise(files.read_jsonl(spark, os.path.join(data_dir, "business.json"), schemas.BUSINESSES), "businesses")
    reviews = files.read_jsonl(spark, os.path.join(data_dir, "review_train.json"), schemas.REVIEWS).select("business_id", "text")
    found = blocks.business_blocks(
        places, lambda: places, lambda: reviews.where("text is not null"), lambda: _photo_vectors(spark, data_dir), PHOTO_DIM
    )
    dims = {part: min(width, PHOTO_DIM) for part, _, width in found.layout}
    slices = found.slices(dims)
    vectors = materialise(found.dense(dims, places), "business-vectors")
    pairs = reduce(files.combine_pairs, [files.read_csv(spark, path, schemas.PAIRS) for path in train_path.split(",")])
    known = materialise(pairs.select("user_id", "business_id").distinct().join(places.select("business_id"), "business_id", "left_semi"), "pairs")
    held = hash32(F.lit("weights"), "user_id", "business_id") % 3 == 0
    history, learned = known.where(~held), known.where(held)
    negatives = ranking.nearest_negatives(known, places, index_ids(places, "business_id")).select("user_id", "negative_id")
    weights = retrieval.part_weights(
        learned, negatives, materialise(retrieval.profiles(history, vectors, slices), "histories"), vectors, slices
    )
    test = materialise(files.read_csv(spark, test_path, schemas.PAIRS).select("user_id", "business_id").distinct(), "test")
    users = materialise(retrieval.profiles(known, vectors, slices).join(test.select("user_id").distinct(), "user_id", "left_semi"), "profiles")
    listed = materialise(retrieval.recommend(users, vectors, weights, slices, k), "recommended")
    files.write_csv(listed.select("user_id", "business_id", "score", "rank"), out_path, "user_id", "rank")
    ranks = materialise(ranking.rank_of(listed, test), "ranks")
    measured = [
        (name, frame.select(F.col(column).alias("value")))
        for name, column, frame in (
            ("recall", "recall", ranking.recall_at_k(ranks, k)), ("ndcg", "ndcg", ranking.ndcg_at_k(ranks, k)),
            ("ndcg_late", "ndcg", ranking.ndcg_at_k(ranks, k, "late")), ("map", "mean_ap", ranking.map_at_k(ranks, k)),
        )
    ]
    metrics = reduce(DataFrame.unionByName, [frame.select(F.lit(name).alias("metric"), "value") for name, frame in measured])
    files.write_csv(metrics, f"{out_path}-metrics", "metric")
    files.write_csv(found.layout_table(), f"{out_path}-layout", "offset")
    files.write_csv(spark.createDataFrame(list(weights.items()), "part string, weight double"), f"{out_path}-weights", "part")
    return files.read_csv(spark, out_path, schemas.RECOMMENDED)


def similarity_job(spark: SparkSession, pairs_path: str, out_path: str, threshold: float = similarity.THRESHOLD) -> DataFrame:
    """Write the similar business pairs of a pair file, sorted, as CSV."""
    pairs = materialise(files.read_csv(spark, pairs_path, schemas.TIPS).distinct(), "pairs")
    edges = similarity.user_sets(pairs, index_ids(pairs, "user_id"))
    found = similarity.similar_businesses(edges, threshold)
    files.write_csv(found, out_path, "business_id_1", "business_id_2")
    return files.read_csv(spark, out_path, schemas.SIMILAR_PAIRS)


# Factorization settings that the search tries: the job's own and weaker ones.
GRID = {"rank": [10, factors.RANK], "reg": [0.5, factors.REG], "alpha": [40.0, factors.ALPHA]}


def tuning_job(spark: SparkSession, tips_path: str, out_path: str, grid: dict[str, list] | None = None, **settings) -> DataFrame:
    """Fit every factorization setting of the grid and write its RMSE as CSV, the best first."""
    counts = materialise(interaction_counts(files.read_jsonl(spark, tips_path, schemas.TIPS)), "counts")
    ratings = implicit_ratings(counts, index_ids(counts, "user_id"), index_ids(counts, "business_id"))
    _, log = factors.tune_als(ratings, grid or GRID, **settings)
    files.write_csv(log, out_path, "rmse", "rank", "reg", "alpha")
    return files.read_csv(spark, out_path, schemas.SETTINGS)


def rmse_job(spark: SparkSession, truth_path: str, predictions_path: str) -> DataFrame:
    """RMSE of a prediction file against a labelled pair file."""
    truth = files.read_csv(spark, truth_path, schemas.PAIRS)
    return evaluation.rmse(files.read_csv(spark, predictions_path, schemas.PREDICTIONS), truth)


def main(argv: list[str]) -> None:
    jobs = {
        "rating": (rating_job, 4, 4), "ranking": (ranking_job, 4, 5), "similar": (similarity_job, 2, 3), "tune": (tuning_job, 2, 2), "rmse": (rmse_job, 2, 2),
    }
    if not argv or argv[0] not in jobs or not jobs[argv[0]][1] <= len(argv) - 1 <= jobs[argv[0]][2]:
        sys.exit(__doc__)
    job, args = jobs[argv[0]][0], argv[1:]
    if job is similarity_job and len(args) == 3:
        args = [*args[:2], float(args[2])]
    if job is ranking_job and len(args) == 5:
        args = [*args[:4], int(args[4])]
    spark = tune(SparkSession.builder.appName(f"affinia-{argv[0]}").getOrCreate())
    try:
        job(spark, *args).show(20, truncate=False)
    finally:
        release(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
