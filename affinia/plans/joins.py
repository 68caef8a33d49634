"""Joins and set operations."""

from pyspark.sql import functions as F

from affinia.functions.scalars import log_affinity, rounded
from affinia.operators import joins as J
from affinia.operators.aggregates import exploded_categories
from affinia.operators.evaluation import residuals
from affinia.operators.interactions import index_ids, interaction_counts, route_pairs
from affinia.operators.profiles import transform_businesses, transform_users
from affinia.operators.similarity import hash_params, minhash, user_sets
from affinia.plans.interactions import BIZ_INDEX, ROUTES, USER_INDEX
from affinia.plans.projections import COUNTS, INVERSE, LOGN, TOKENS, USER_COLUMNS
from affinia.plans.registry import query, r


def given_scores(t):
    """Scores with the shape of a factorization's: log affinity where the pair has
    interactions, 1 where an id is unknown, none otherwise."""
    known = t.counts.select(
        "user_id", "business_id", log_affinity("n").alias("score"), F.lit("model").alias("score_source")
    )
    cold = route_pairs(t.pairs, t.counts, t.counts).where("route = 'missing'").select(
        "user_id", "business_id", F.lit(1.0).alias("score"), F.lit("default").alias("score_source")
    )
    return known.unionByName(cold)


GIVEN = f"""{COUNTS}, {ROUTES}, given AS (
  SELECT user_id, business_id, {LOGN} AS s, 'model' AS score_source FROM counts UNION ALL
  SELECT user_id, business_id, 1.0, 'default' FROM routes WHERE NOT (user_known AND business_known)),
profile AS (SELECT {USER_COLUMNS} FROM users),
features AS (
  SELECT p.user_id, p.business_id, p.stars, g.s AS score, coalesce(g.score_source, 'absent') AS score_source,
    u.* EXCLUDE (user_id), b.stars AS bus_stars, b.review_count AS bus_review_count, b.is_open,
    coalesce(50 * ({INVERSE}), 0) AS affinity_score
  FROM pairs p LEFT JOIN given g USING (user_id, business_id) LEFT JOIN profile u ON u.user_id = p.user_id
  LEFT JOIN businesses b ON b.business_id = p.business_id)"""


def features(t):
    t.shared()
    return J.feature_rows(t.pairs, given_scores(t), transform_users(t.users), transform_businesses(t.businesses))


@query("feature_rows", f"""SELECT * REPLACE ({r('score')} AS score, {r('affinity_score', 4)} AS affinity_score) FROM features""", GIVEN, inline=True)
def feature_rows(t):
    return features(t).withColumns({"score": rounded("score"), "affinity_score": rounded("affinity_score", 4)})


@query("review_user_business", """SELECT v.review_id, v.user_id, v.business_id, v.stars, v.useful AS useful_review,
  u.useful AS useful_user, u.review_count, b.stars AS stars_business, b.review_count AS review_count_business, b.city
  FROM reviews v JOIN users u USING (user_id) JOIN businesses b USING (business_id)""")
def review_user_business(t):
    t.shared()
    return J.interaction_rows(t.reviews, t.users, t.businesses).select(
        "review_id", "user_id", "business_id", "stars", "useful_review", "useful_user", "review_count",
        "stars_business", "review_count_business", "city",
    )


@query("semi_join_keys", """SELECT review_id, user_id, business_id FROM reviews
  WHERE user_id IN (SELECT user_id FROM users WHERE elite <> 'None')
  AND business_id IN (SELECT business_id FROM businesses WHERE is_open = 1)""")
def semi_join_keys(t):
    kept = J.known_only(t.reviews, t.users.where("elite <> 'None'"), "user_id")
    return J.known_only(kept, t.places.where("is_open = 1"), "business_id").select("review_id", "user_id", "business_id")


COMPLEMENT = f"""{USER_INDEX}, {BIZ_INDEX},
positives AS (SELECT DISTINCT user_id, business_id FROM tips),
rest AS (SELECT u.user_id, b.business_id, b.idx,
    row_number() OVER (PARTITION BY u.user_id ORDER BY b.idx) - 1 AS ordinal
  FROM user_index u CROSS JOIN biz_index b ANTI JOIN positives p ON p.user_id = u.user_id AND p.business_id = b.business_id)"""


@query("anti_join_negatives", """SELECT user_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n
  FROM rest GROUP BY user_id, idx - ordinal""", COMPLEMENT)
def anti_join_negatives(t):
    index = index_ids(t.counts, "business_id")
    owned = t.counts.join(index, "business_id")
    return J.candidate_ranges(owned, "user_id", index.agg(F.count("*")).scalar())


@query("composite_key_join", f"""SELECT p.user_id, p.business_id, t.stars, p.prediction, {r('p.prediction - t.stars', 4)} AS error
  FROM predictions p JOIN pairs t USING (user_id, business_id)""", inline=True)
def composite_key_join(t):
    both = t.pairs.join(t.predictions.drop("stars"), ["user_id", "business_id"])
    return residuals(both).withColumn("error", rounded("error", 4))


def rule_clusters(t):
    """User clusters by a rule, for checks that need fixed clusters."""
    return t.table("customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.expr("CAST(c_custkey % 7 * (c_custkey % 2) AS INT)").alias("Cluster"),
    )


CLUSTERS = """clusters AS (SELECT concat('u', CAST(c_custkey AS STRING)) AS user_id,
  CAST(c_custkey % 7 * (c_custkey % 2) AS INT) AS "Cluster" FROM customer)"""


@query("join_clusters", 'SELECT p.user_id, p.business_id, p.stars, c."Cluster" FROM pairs p LEFT JOIN clusters c USING (user_id)', CLUSTERS)
def join_clusters(t):
    return J.attach_cluster(t.pairs, rule_clusters(t))


@query("renamed_key_join", f"""SELECT e.business_id, e.category, md5(e.category) AS category_md5, c.n
  FROM (SELECT business_id, unnest({TOKENS}) AS category FROM businesses) e
  LEFT JOIN (SELECT category, count(*) AS n FROM (SELECT unnest({TOKENS}) AS category FROM businesses) GROUP BY 1) c USING (category)""")
def renamed_key_join(t):
    edges = exploded_categories(t.places)
    coded = edges.withColumn("category_md5", F.md5("category"))
    sizes = edges.groupBy(F.md5("category").alias("type")).agg(F.count("*").alias("n"))
    return J.join_renamed(coded, sizes, "category_md5", "type")


@query("rdd_pair_join", """SELECT p.user_id, p.business_id, p.stars, c.n FROM pairs p LEFT JOIN counts c USING (user_id, business_id)""", COUNTS)
def rdd_pair_join(t):
    return t.pairs.join(interaction_counts(t.tips), ["user_id", "business_id"], "left")


@query("positional_concat", """SELECT p.user_id, p.business_id, p.prediction, u.average_stars, b.stars AS bus_stars
  FROM predictions p LEFT JOIN users u USING (user_id) LEFT JOIN businesses b USING (business_id)""")
def positional_concat(t):
    users = t.shared().users.select("user_id", "average_stars")
    businesses = t.businesses.select("business_id", F.col("stars").alias("bus_stars"))
    return t.predictions.drop("stars").join(users, "user_id", "left").join(businesses, "business_id", "left")


EDGES = f"""{USER_INDEX}, edges AS (SELECT DISTINCT business_id, idx AS user_idx FROM tips JOIN user_index USING (user_id))"""


def minhash_sql(n: int = 50) -> str:
    """(business_id, h, v): each hash's smallest value, from one row per hash."""
    params = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(hash_params(n)))
    return f"""params(h, a, b) AS (VALUES {params}),
sig AS (SELECT business_id, h, min((CAST(a AS BIGINT) * user_idx + b) % 2147483647) AS v
  FROM edges CROSS JOIN params GROUP BY business_id, h)"""


def bands_sql(rows: int, n: int = 50) -> str:
    """(business_id, band, key): the signature in bands of `rows` values."""
    return f"""{EDGES}, {minhash_sql(n)},
bands AS (SELECT business_id, h // {rows} AS band, list(v ORDER BY h) AS key
  FROM sig WHERE h < {n // rows * rows} GROUP BY business_id, h // {rows})"""


@query("self_join_pairs", """SELECT CAST(band AS INT) AS band, first_id AS business_id_1, business_id AS business_id_2 FROM (
  SELECT *, min(business_id) OVER (PARTITION BY band, key) AS first_id FROM bands) WHERE business_id <> first_id""", bands_sql(2))
def self_join_pairs(t):
    """Members of a MinHash bucket, each paired with the bucket's smallest id: the
    bucket's pairs in linear form."""
    sets = user_sets(t.counts, index_ids(t.counts, "user_id"))
    signed = minhash(sets, hash_params())
    banded = signed.select(
        "business_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda b: F.struct(
            b.alias("band"), F.slice("signature", b * 2 + 1, 2).alias("key")))).alias("x"),
    ).select("business_id", "x.*")
    firsts = banded.groupBy("band", "key").agg(F.min("business_id").alias("business_id_1"))
    return banded.join(firsts, ["band", "key"]).where("business_id <> business_id_1").select(
        "band", "business_id_1", F.col("business_id").alias("business_id_2")
    )


# --- set operations --------------------------------------------------------


@query("union_all", """SELECT user_id, business_id, s_source FROM (
  SELECT user_id, business_id, 'model' AS s_source FROM counts UNION ALL
  SELECT user_id, business_id, 'default' FROM routes WHERE NOT (user_known AND business_known))""", f"{COUNTS}, {ROUTES}")
def union_all(t):
    return given_scores(t).select("user_id", "business_id", F.col("score_source").alias("s_source"))


@query("distinct_rows", "SELECT DISTINCT user_id, business_id FROM tips")
def distinct_rows(t):
    return t.tips.distinct()


@query("intersect_keys", "SELECT user_id FROM tips INTERSECT SELECT user_id FROM reviews WHERE flag = 'N'")
def intersect_keys(t):
    return t.tips.select("user_id").intersect(t.reviews.where("flag = 'N'").select("user_id"))


@query("except_keys", """SELECT user_id, business_id FROM reviews EXCEPT SELECT user_id, business_id FROM tips""")
def except_keys(t):
    pair = ["user_id", "business_id"]
    return t.reviews.select(*pair).distinct().join(t.tips.distinct(), pair, "left_anti")
