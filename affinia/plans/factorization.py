"""Factorization, pair scores and their search."""

from pyspark.sql import functions as F

from affinia.functions.scalars import rounded
from affinia.functions.vectors import norm
from affinia.operators import factors as M
from affinia.operators.aggregates import pool, union_all
from affinia.operators.cells import mean_of_edges
from affinia.operators.interactions import implicit_ratings, index_ids, top_k_per
from affinia.plans.aggregations import DIM
from affinia.plans.registry import query, r

# An earlier, smaller setting of the rating job; the default of `fit_als` is the last one.
SETTINGS = {"rank": 10, "reg": 0.5, "alpha": 1520.0}


def indexed(t, raw=False):
    """User index, business index and ratings of the tips."""
    users, businesses = index_ids(t.counts, "user_id"), index_ids(t.counts, "business_id")
    return users, businesses, implicit_ratings(t.counts, users, businesses, raw=raw)


def fitted(t):
    users, businesses, ratings = indexed(t)
    return M.fit_als(ratings, **SETTINGS), users, businesses


def business_vectors(t):
    """Given vectors: mean photo vector of a business."""
    return pool(t.photos, "business_id", "embedding", DIM)


def user_vectors(t):
    """Given vectors: mean vector of the businesses a user tipped."""
    return mean_of_edges(t.counts, business_vectors(t), "user_id", "business_id")


VECTORS = """biz_pos AS (SELECT business_id, pos, avg(v) AS v FROM (SELECT business_id, unnest(embedding) AS v,
    generate_subscripts(embedding, 1) AS pos FROM photos WHERE list_dot_product(embedding, embedding) > 0) GROUP BY ALL),
user_pos AS (SELECT user_id, pos, avg(v) AS v FROM (SELECT DISTINCT user_id, business_id FROM tips) JOIN biz_pos USING (business_id) GROUP BY ALL),
biz_vec AS (SELECT business_id, list(v ORDER BY pos) AS bv FROM biz_pos GROUP BY business_id),
user_vec AS (SELECT user_id, list(v ORDER BY pos) AS uv FROM user_pos GROUP BY user_id)"""


@query("pair_affinity", f"""SELECT user_id, business_id, {r('coalesce(list_dot_product(uv, bv), 1)', 5)} AS score,
  CASE WHEN uv IS NULL OR bv IS NULL THEN 'default' ELSE 'model' END AS score_source
  FROM (SELECT DISTINCT user_id, business_id FROM pairs) LEFT JOIN user_vec USING (user_id) LEFT JOIN biz_vec USING (business_id)""", VECTORS)
def pair_affinity(t):
    return M.score_pairs(t.pairs, user_vectors(t), business_vectors(t)).withColumn("score", rounded("score", 5))


@query("default_vectors", f"""SELECT user_id, uv IS NULL AS is_default, {r('coalesce(sqrt(list_dot_product(uv, uv)), 0)', 5)} AS length
  FROM (SELECT DISTINCT user_id FROM pairs) LEFT JOIN user_vec USING (user_id)""", VECTORS)
def default_vectors(t):
    return M.complete_vectors(t.pairs, "user_id", user_vectors(t), DIM).select(
        "user_id", "is_default", rounded(norm("features"), 5).alias("length")
    )


@query("als_fit")
def als_fit(t):
    """Fitted factors of both sides: id, position, value."""
    model, _, _ = fitted(t)
    sides = [
        v.select(F.lit(side).alias("side"), "id", F.posexplode("features").alias("pos", "value"))
        for side, v in (("user", model.userFactors), ("business", model.itemFactors))
    ]
    return union_all(sides)


@query("als_factors")
def als_factors(t):
    """Vector of every user and business of the tips, by its id: side, id, features."""
    users, businesses = M.factors(*fitted(t))
    return union_all([
        v.select(F.lit(side).alias("side"), F.col(f"{side}_id").alias("id"), "features")
        for side, v in (("user", users), ("business", businesses))
    ])


@query("als_pair_affinity")
def als_pair_affinity(t):
    """Pairs scored by fitted vectors, with the source of each score."""
    return M.score_pairs(t.pairs, *M.factors(*fitted(t)))


@query("all_pairs_affinity")
def all_pairs_affinity(t):
    """Best 10 of all businesses per user, with their scores."""
    model, users, businesses = fitted(t)
    return (
        M.score_all(model, 10).join(users, F.col("user") == users.idx).drop("idx")
        .join(businesses, F.col("business") == businesses.idx).select("user_id", "business_id", "score")
    )


@query("als_top_k")
def als_top_k(t):
    """Top 3 businesses per user by fitted score, with ids."""
    model, users, businesses = fitted(t)
    scores = (
        M.score_all(model, 10).join(users, F.col("user") == users.idx).drop("idx")
        .join(businesses, F.col("business") == businesses.idx).select("user_id", "business_id", "score")
    )
    return top_k_per(scores, ["user_id"], [F.desc("score"), "business_id"], 3)


@query("als_holdout_rmse")
def als_holdout_rmse(t):
    """RMSE on held-out pairs of a fit on log ratings and of one on raw counts."""
    return union_all([
        M.evaluate_als(indexed(t, raw)[2], **SETTINGS).select(F.lit(name).alias("rating"), "n_scored", "rmse")
        for name, raw in (("log", False), ("raw", True))
    ])


GRID = {"rank": [48, 50, 55], "reg": [0.00001, 0.0001, 0.0005], "alpha": [4.5, 5.0, 6.0]}
FOLD_GRID = {"rank": [45, 48, 50], "reg": [0.0001, 0.0005, 0.001], "alpha": [4.0, 4.5, 5.0]}


@query("als_grid_search")
def als_grid_search(t):
    return M.tune_als(indexed(t)[2], GRID)[1]


@query("als_kfold")
def als_kfold(t):
    return M.tune_als(indexed(t)[2], FOLD_GRID, folds=5)[1]

