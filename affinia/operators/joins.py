"""Feature rows and the join shapes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.functions.scalars import AFFINITY_FACTOR, MAX_INTERACTIONS, magnified_affinity
from affinia.operators.interactions import PAIR
from affinia.operators.scale import bucketed_row_number, slices
from affinia.session import materialise


def feature_rows(
    pairs: DataFrame, scores: DataFrame, users: DataFrame, businesses: DataFrame,
    k: float = AFFINITY_FACTOR, max_n: int = MAX_INTERACTIONS,
) -> DataFrame:
    """Pairs with score, user and business columns and the affinity score.

    Scores, users and businesses are unique per key, so every pair stays one row.
    A pair without score is marked 'absent' and gets affinity 0.
    """
    unique_scores = scores.dropDuplicates(PAIR)
    if "score_source" not in scores.columns:
        unique_scores = unique_scores.withColumn("score_source", F.lit("model"))
    return (
        pairs.join(unique_scores, PAIR, "left")
        .join(users, "user_id", "left")
        .join(businesses, "business_id", "left")
        .withColumn("affinity_score", magnified_affinity("score", k, max_n))
        .withColumn("score_source", F.coalesce("score_source", F.lit("absent")))
        .drop("categories", "city")
    )


def interaction_rows(reviews: DataFrame, users: DataFrame, businesses: DataFrame) -> DataFrame:
    """Reviews with their user and business; shared names get a suffix."""

    def suffixed(df: DataFrame, key: str, taken: set[str], suffix: str) -> DataFrame:
        return df.select([F.col(c).alias(c if c == key or c not in taken else c + suffix) for c in df.columns])

    user_names = set(users.columns) - {"user_id"}
    r = suffixed(reviews, "user_id", user_names, "_review")
    u = suffixed(users, "user_id", set(reviews.columns), "_user")
    rows = r.join(u, "user_id")
    return rows.join(suffixed(businesses, "business_id", set(rows.columns), "_business"), "business_id")


def known_only(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows whose key occurs in another frame."""
    return df.join(keys.select(col), col, "left_semi")


def attach_cluster(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Feature rows with the cluster of their user; null for users without one."""
    return rows.join(clusters, "user_id", "left")


def join_renamed(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on unlike key names, without the helper key in the result."""
    return left.join(right, left[left_key] == right[right_key], "left").drop(right[right_key])


def left_join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join where the right side has the many rows of a hot key.

    Spark can split a hot key of the right side only in an inner join, so rows with
    a match come from one, and left keys without any are added.
    """
    extra = [c for c in right.columns if c != key]
    matched = right.join(left, key).select(*left.columns, *extra)
    alone = left.join(right.select(key).distinct(), key, "left_anti").select(
        *left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra]
    )
    return matched.unionByName(alone)


def ranked_positives(positives: DataFrame, keys: list[str], total: DataFrame) -> DataFrame:
    """Positives (keys, idx) with their rank, the group size and the complement size.

    `total` holds (keys, n_items): how many items the group can choose from,
    numbered 0 .. n_items - 1.
    """
    sizes = positives.groupBy(*keys).agg(F.count("*").alias("n_positives"))
    sized = (
        positives.join(sizes, keys)
        .join(total, [k for k in keys if k in total.columns])
        .withColumn("parts", slices(F.col("n_positives")))
        .withColumn("bucket", F.floor(F.col("idx") * F.col("parts") / F.col("n_items")))
    )
    return bucketed_row_number(sized, keys, "bucket", ["idx"], "rank").drop("bucket")


def candidate_ranges(positives: DataFrame, key: str, n_items) -> DataFrame:
    """All items minus a key's positives, as ranges of the dense item index.

    The full complement has users x items rows; its ranges have one row more than
    the positives at most. Neighbours are found by joining rank i to rank i + 1,
    which spreads a hot key over all tasks.
    """
    keyed = materialise(positives.select(key, "idx").distinct(), "positives")
    total = keyed.select(key).distinct().withColumn("n_items", n_items)
    ranked = materialise(ranked_positives(keyed, [key], total), "ranked-positives")
    ends = ranked.groupBy(key).agg(F.max("n_positives").alias("n_positives"), F.max("n_items").alias("n_items"))
    left = ranked.select(key, "rank", (F.col("idx") + 1).alias("first_idx")).unionByName(
        ends.select(key, F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("first_idx"))
    )
    right = ranked.select(key, (F.col("rank") - 1).alias("rank"), (F.col("idx") - 1).alias("last_idx")).unionByName(
        ends.select(key, F.col("n_positives").alias("rank"), (F.col("n_items") - 1).alias("last_idx"))
    )
    return (
        left.join(right, [key, "rank"])
        .where(F.col("first_idx") <= F.col("last_idx"))
        .select(key, "first_idx", "last_idx", (F.col("last_idx") - F.col("first_idx") + 1).alias("n"))
    )
