"""Retrieval: profiles of users from what they visited, weights of the parts learned from negatives, and the best k."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.functions.vectors import l2_normalize
from affinia.operators.aggregates import pool
from affinia.operators.blocks import part_products
from affinia.operators.topk import product_top_k
from affinia.session import materialise


def profiles(pairs: DataFrame, vectors: DataFrame, slices: dict[str, tuple[int, int]]) -> DataFrame:
    """(user_id, features): mean vector of the businesses a user visited, every part of unit length or zero."""
    dim = sum(size for _, size in slices.values())
    visited = pairs.select("user_id", "business_id").distinct().join(vectors, "business_id")
    mean = pool(visited, "user_id", "features", dim, skip_zeros=False)
    parts = [l2_normalize(F.slice("features", at + 1, size)) for at, size in slices.values() if size]
    return mean.select("user_id", F.concat(*parts).alias("features"))


def part_weights(
    positives: DataFrame, negatives: DataFrame, users: DataFrame, vectors: DataFrame, slices: dict[str, tuple[int, int]]
) -> dict[str, float]:
    """Weight of every part's cosine, from a logistic fit of visited against unvisited businesses.

    `positives` is (user_id, business_id), `negatives` (user_id, negative_id). A part that speaks against a
    visit weighs 0; if all do, or there are not both classes, all parts weigh the same.
    """
    labelled = positives.select("user_id", "business_id", F.lit(1.0).alias("label")).unionByName(
        negatives.select("user_id", F.col("negative_id").alias("business_id"), F.lit(0.0).alias("label"))
    )
    u, b = users.withColumnRenamed("features", "u"), vectors.withColumnRenamed("features", "b")
    rows = labelled.join(u, "user_id").join(b, "business_id").select("label", *part_products(F.col("u"), F.col("b"), slices))
    rows = materialise(rows.select("label", array_to_vector(F.array(*slices)).alias("features")), "retrieval-rows")
    if rows.select("label").distinct().count() < 2:
        return dict.fromkeys(slices, 1.0)
    model = LogisticRegression(maxIter=100, regParam=1e-4, standardization=False).fit(rows)
    weights = {part: max(0.0, float(w)) for part, w in zip(slices, model.coefficients)}
    return weights if any(weights.values()) else dict.fromkeys(slices, 1.0)


def recommend(users: DataFrame, vectors: DataFrame, weights: dict[str, float], slices: dict[str, tuple[int, int]], k: int = 10) -> DataFrame:
    """(user_id, business_id, score, rank): the k businesses with the highest weighted sum of part cosines."""
    scaled = [F.transform(F.slice("features", at + 1, size), lambda x, w=weights[part]: x * w) for part, (at, size) in slices.items() if size]
    weighted = users.select("user_id", F.concat(*scaled).alias("features"))
    found = product_top_k(weighted, vectors, "user_id", "business_id", "features", k=k)
    return found.withColumnsRenamed({"query_id": "user_id", "item_id": "business_id"})
