"""Feedback, category, pooling and summary aggregations."""

from pyspark.sql import functions as F

from affinia.functions.scalars import rounded
from affinia.operators import aggregates as A
from affinia.operators.profiles import transform_reviews
from affinia.plans.joins import CLUSTERS, rule_clusters
from affinia.plans.projections import AS_OF, TOKENS
from affinia.plans.registry import query, r
from affinia.session import materialise

DIM = 64  # length of the vectors in `embeddings`

RATED = f"""rated AS (SELECT review_id, user_id, business_id, useful, cool + funny + useful AS ufc,
  (cool + funny + useful) / greatest(date_diff('day', CAST(date AS DATE), DATE '{AS_OF}') / 365e0, 1e0) AS rate FROM reviews)"""


def feedback_sql(entity: str, key: str) -> str:
    return f"""SELECT e.{key}, {r('coalesce(a.total, 0)', 4)} AS total_ufc_count_per_year,
  {r('coalesce(a.mean, 0)')} AS avg_ufc_count_per_review FROM {entity} e
  LEFT JOIN (SELECT {key}, sum(rate) AS total, avg(ufc) AS mean FROM rated GROUP BY {key}) a USING ({key})"""


def feedback(t, entities, key):
    return A.feedback(entities.select(key), transform_reviews(t.reviews, AS_OF), key).select(
        key, rounded("total_ufc_count_per_year", 4).alias("total_ufc_count_per_year"),
        rounded("avg_ufc_count_per_review").alias("avg_ufc_count_per_review"),
    )


@query("user_feedback_rate", f"SELECT user_id, total_ufc_count_per_year FROM ({feedback_sql('users', 'user_id')})", RATED)
def user_feedback_rate(t):
    return feedback(t, t.users, "user_id").drop("avg_ufc_count_per_review")


@query("user_feedback_mean", f"SELECT user_id, avg_ufc_count_per_review FROM ({feedback_sql('users', 'user_id')})", RATED)
def user_feedback_mean(t):
    return feedback(t, t.users, "user_id").drop("total_ufc_count_per_year")


@query("business_feedback", feedback_sql("businesses", "business_id"), RATED)
def business_feedback(t):
    return feedback(t, t.places, "business_id")


@query("business_usefulness", f"SELECT business_id, {r('avg(useful)')} AS avg_useful_score FROM reviews GROUP BY business_id")
def business_usefulness(t):
    return A.avg_useful(t.reviews).withColumn("avg_useful_score", rounded("avg_useful_score"))


EDGES = f"cat_edges AS (SELECT business_id, unnest({TOKENS}) AS category FROM businesses)"
MAP = f"""{EDGES}, cat_map AS (SELECT e.category, md5(e.category) AS category_md5, e.business_id, v.user_id
  FROM cat_edges e LEFT JOIN reviews v USING (business_id))"""
SETS = f"""{MAP}, sets AS (SELECT category, category_md5, count(DISTINCT business_id) AS n_businesses,
  count(DISTINCT user_id) AS n_users FROM cat_map GROUP BY ALL),
share AS (SELECT category, count(*) / (SELECT count(DISTINCT business_id) FROM businesses) AS p FROM cat_edges GROUP BY category)"""


@query("category_edges", """SELECT md5(category) AS type, business_id || '_bid' AS bid_cat FROM cat_edges
  UNION ALL SELECT DISTINCT business_id || '_bid', business_id || '_bid' FROM cat_edges""", EDGES)
def category_edges(t):
    return A.category_edges(t.places)


@query("category_dictionary", "SELECT DISTINCT category, md5(category) AS category_md5 FROM cat_edges", EDGES)
def category_dictionary(t):
    return A.category_dictionary(t.places)


@query("category_user_map", "SELECT * FROM cat_map", MAP)
def category_user_map(t):
    return A.category_user_map(t.places, t.reviews)


def category_visits(t):
    """The category map over distinct (user, business) pairs."""
    return A.category_user_map(t.places, t.shared().visited)


@query("category_sets", "SELECT * FROM sets", SETS)
def category_sets(t):
    return A.visited_category_sets(t.places, t.shared().visited)


@query("top_business_categories", f"""SELECT category, n_businesses AS business_count, n_users AS user_count, {r('p')} AS proportion
  FROM (SELECT * FROM sets ORDER BY n_businesses DESC, category LIMIT 10) JOIN share USING (category)""", SETS)
def top_business_categories(t):
    top = A.top_categories(category_visits(t), t.places)
    return top.withColumn("proportion", rounded("proportion"))


@query("top_categories_by_dimension", f"""SELECT category, n_users AS user_count,
  {r('n_users / (SELECT count(DISTINCT user_id) FROM reviews)')} AS proportion
  FROM sets ORDER BY n_users DESC, category LIMIT 10""", SETS)
def top_categories_by_dimension(t):
    total = t.reviews.agg(F.count_distinct("user_id")).scalar()
    top = A.top_categories_by(category_visits(t), t.places, "user", total)
    return top.withColumn("proportion", rounded("proportion"))


def long(df, key):
    """Vectors as rows for the comparison."""
    return df.select(key, F.posexplode("features").alias("pos", "value")).withColumn("value", rounded("value", 5))


def pool_sql(how: str) -> str:
    return f"""SELECT b.business_id, CAST(d.pos AS INT) AS pos, {r('coalesce(p.v, 0)', 5)} AS value
  FROM businesses b CROSS JOIN (SELECT unnest(range({DIM})) AS pos) d LEFT JOIN (
    SELECT business_id, pos, {how}(v) AS v FROM (SELECT business_id, unnest(embedding) AS v,
      generate_subscripts(embedding, 1) - 1 AS pos FROM photos WHERE list_dot_product(embedding, embedding) > 0)
    GROUP BY business_id, pos) p ON p.business_id = b.business_id AND p.pos = d.pos"""


@query("embedding_pool_mean", pool_sql("avg"))
def embedding_pool_mean(t):
    return long(A.pool(t.photos, "business_id", "embedding", DIM, "mean", t.places), "business_id")


@query("embedding_pool_max", pool_sql("max"))
def embedding_pool_max(t):
    return long(A.pool(t.photos, "business_id", "embedding", DIM, "max", t.places), "business_id")


@query("photo_lists", """SELECT business_id, photo_id, n_photos FROM photos
  JOIN (SELECT business_id, count(*) AS n_photos FROM photos GROUP BY business_id) USING (business_id)""")
def photo_lists(t):
    return A.photo_lists(t.photos)


@query("user_positive_sets", """SELECT user_id, business_id, n_positives FROM (SELECT DISTINCT user_id, business_id FROM tips)
  JOIN (SELECT user_id, count(DISTINCT business_id) AS n_positives FROM tips GROUP BY user_id) USING (user_id)""")
def user_positive_sets(t):
    return A.positives(t.tips)


@query("mean_location", f"""SELECT 'user' AS kind, user_id AS id, {r('avg(latitude)')} AS latitude, {r('avg(longitude)')} AS longitude
  FROM reviews JOIN businesses USING (business_id) GROUP BY user_id
  UNION ALL SELECT 'business', business_id, {r('avg(latitude)')}, {r('avg(longitude)')}
  FROM reviews JOIN businesses USING (business_id) GROUP BY business_id""")
def mean_location(t):
    located = t.reviews.select("user_id", "business_id").join(
        t.places.select("business_id", "latitude", "longitude"), "business_id"
    )
    parts = [
        A.mean_location(located, f"{kind}_id").select(
            F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"),
            rounded("latitude").alias("latitude"), rounded("longitude").alias("longitude"),
        )
        for kind in ("user", "business")
    ]
    return A.union_all(parts)


@query("category_inverted_index", """SELECT category, business_id, n_businesses, n_categories FROM (SELECT DISTINCT * FROM cat_edges)
  JOIN (SELECT category, count(DISTINCT business_id) AS n_businesses FROM cat_edges GROUP BY category) USING (category)
  JOIN (SELECT business_id, count(DISTINCT category) AS n_categories FROM cat_edges GROUP BY business_id) USING (business_id)""", EDGES)
def category_inverted_index(t):
    return A.inverted_index(t.places)


@query("distinct_counts", """SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT business_id) AS n_business_id,
  count(*) AS n_rows FROM reviews""")
def distinct_counts(t):
    return A.distinct_counts(t.reviews, ["user_id", "business_id"])


def profile_sql(relation: str, by: list[str], features: list[str], digits: int = 4) -> str:
    keys = "".join(f"{b}, " for b in by)
    stats = ", ".join(
        f"{r(e, digits)} AS {n}" for e, n in (
            ("avg(value)", "mean"), ("stddev_samp(value)", "std"), ("min(value)", "min"), ("max(value)", "max"),
            ("quantile_cont(value, 0.25)", "q25"), ("quantile_cont(value, 0.5)", "q50"), ("quantile_cont(value, 0.75)", "q75"),
        )
    )
    long_rows = " UNION ALL ".join(f"SELECT {keys}'{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {relation}" for f in features)
    return f"SELECT {keys}feature, count(value) AS n, {stats} FROM ({long_rows}) GROUP BY {keys}feature"


def rounded_profile(df, digits: int = 4):
    return df.withColumns({c: rounded(c, digits) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")})


PROFILED = ["average_stars", "review_count", "fans", "useful"]


@query("cluster_profile", profile_sql("clustered", ['"Cluster"'], PROFILED),
       CLUSTERS + ', clustered AS (SELECT p.user_id, c."Cluster", u.average_stars, u.review_count, u.fans, u.useful '
       'FROM pairs p JOIN clusters c USING (user_id) JOIN users u USING (user_id))')
def cluster_profile(t):
    users = t.shared().users.select("user_id", *PROFILED)
    rows = t.pairs.select("user_id").join(rule_clusters(t), "user_id").join(users, "user_id")
    # moments, brackets and counts each read the rows
    return rounded_profile(A.profile(materialise(rows, "profiled"), ["Cluster"], PROFILED))


@query("city_share", f"""SELECT city, count(*) AS n, {r('count(*) / (SELECT count(*) FROM located) * 100')} AS percentage
  FROM located GROUP BY city""", "located AS (SELECT p.*, b.city FROM pairs p JOIN businesses b USING (business_id))")
def city_share(t):
    rows = t.pairs.join(t.places.select("business_id", "city"), "business_id")
    return A.share(rows, "city").withColumn("percentage", rounded("percentage"))


PARAMS = ["average_stars", "review_count", "fans", "compliment_hot"]


@query("param_metric_correlation", " UNION ALL ".join(
    f"SELECT '{p}' AS param, {r(f'corr({p}, rmse)')} AS r FROM scored_users" for p in PARAMS),
    """scored_users AS (SELECT u.*, e.rmse FROM users u JOIN (
      SELECT user_id, sqrt(avg((prediction - stars) * (prediction - stars))) AS rmse FROM predictions GROUP BY user_id) e USING (user_id))""")
def param_metric_correlation(t):
    d = F.col("prediction") - F.col("stars")
    per_user = t.predictions.groupBy("user_id").agg(F.sqrt(F.avg(d * d)).alias("rmse"))
    return A.corr_table(t.users.join(per_user, "user_id"), PARAMS, "rmse").withColumn("r", rounded("r"))


@query("group_sizes", 'SELECT "Cluster", count(*) AS n FROM pairs JOIN clusters USING (user_id) GROUP BY "Cluster"', CLUSTERS)
def group_sizes(t):
    return A.group_sizes(t.pairs.join(rule_clusters(t), "user_id"), "Cluster")


@query("score_summary", profile_sql("predictions", [], ["prediction"]))
def score_summary(t):
    return rounded_profile(A.profile(t.scored, [], ["prediction"]))
