"""Interaction counts, ids and pair routing."""

from pyspark.sql import functions as F

from affinia.functions.scalars import rounded
from affinia.operators import interactions as I
from affinia.plans.projections import COUNTS, LOGN
from affinia.plans.registry import query, r

USER_INDEX = "user_index AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM tips))"
BIZ_INDEX = "biz_index AS (SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS idx FROM (SELECT DISTINCT business_id FROM tips))"


@query("interaction_counts", "SELECT * FROM counts", COUNTS)
def interaction_counts(t):
    return I.interaction_counts(t.tips)


@query("user_interaction_lists", """SELECT user_id, business_id, n, list_size
  FROM counts JOIN (SELECT user_id, count(*) AS list_size FROM counts GROUP BY user_id) USING (user_id)""", COUNTS)
def user_interaction_lists(t):
    return I.interaction_lists(I.interaction_counts(t.tips))


@query("id_index", "SELECT 'user' AS kind, user_id AS id, idx FROM user_index UNION ALL SELECT 'business', business_id, idx FROM biz_index",
       f"{USER_INDEX}, {BIZ_INDEX}")
def id_index(t):
    users = I.index_ids(t.counts, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "idx")
    biz = I.index_ids(t.counts, "business_id").select(F.lit("business").alias("kind"), F.col("business_id").alias("id"), "idx")
    return users.unionByName(biz)


@query("label_encode", """SELECT business_id, city, dense_rank() OVER (ORDER BY city) - 1 AS city_encoded FROM businesses""")
def label_encode(t):
    return I.label_encode(t.places.select("business_id", "city"), "city")


@query("reverse_index", """SELECT p.business_id, coalesce(i.user_id, 'Unknown') AS user_id, count(*) AS n
  FROM pairs p LEFT JOIN user_index i USING (user_id) GROUP BY ALL""", USER_INDEX)
def reverse_index(t):
    index = I.index_ids(t.tips, "user_id")
    coded = t.pairs.join(index, "user_id", "left").select("business_id", F.coalesce("idx", F.lit(-1)).alias("idx"))
    return I.decode_ids(coded, index, "idx", "user_id").groupBy("business_id", "user_id").agg(F.count("*").alias("n"))


HALF = f"""CASE WHEN s < 2 THEN round_even(s * 1024, 0) / 1024 WHEN s < 4 THEN round_even(s * 512, 0) / 512
  ELSE round_even(s * 256, 0) / 256 END"""


@query("implicit_ratings", f"""SELECT CAST(u.idx AS INT) AS "user", CAST(b.idx AS INT) AS business, {HALF} AS rating
  FROM (SELECT *, {LOGN} AS s FROM counts) JOIN user_index u USING (user_id) JOIN biz_index b USING (business_id)""",
       f"{COUNTS}, {USER_INDEX}, {BIZ_INDEX}")
def implicit_ratings(t):
    rated = I.implicit_ratings(t.counts, I.index_ids(t.counts, "user_id"), I.index_ids(t.counts, "business_id"))
    return rated.withColumn("rating", F.col("rating").cast("double"))


ROUTES = """routes AS (SELECT p.*, u.user_id IS NOT NULL AS user_known, b.business_id IS NOT NULL AS business_known
  FROM pairs p LEFT JOIN (SELECT DISTINCT user_id FROM tips) u USING (user_id)
  LEFT JOIN (SELECT DISTINCT business_id FROM tips) b USING (business_id))"""


@query("pair_routing", """SELECT user_id, business_id, stars, user_known, business_known,
  CASE WHEN user_known AND business_known THEN 'valid' ELSE 'missing' END AS route FROM routes""", ROUTES)
def pair_routing(t):
    t.shared()
    return I.route_pairs(t.pairs, t.counts, t.counts)


@query("user_top_k", f"""SELECT user_id, business_id, n, CAST(rank AS INT) AS rank, {r(LOGN)} AS affinity FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, business_id) AS rank FROM counts) WHERE rank <= 3""", COUNTS)
def user_top_k(t):
    """Flagship: top 3 businesses per user by interaction count, with log affinity."""
    return I.user_top_k(I.interaction_counts(t.tips)).withColumn("affinity", rounded("affinity"))


@query("interaction_stats", f"""SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT business_id) AS n_businesses,
  count(*) AS n_pairs, {r('avg(n)')} AS mean_n, {r('stddev_pop(n)')} AS stdev_n, max(n) AS max_n, min(n) AS min_n FROM counts""", COUNTS)
def interaction_stats(t):
    stats = I.interaction_stats(I.interaction_counts(t.tips))
    return stats.withColumns({c: rounded(c) for c in ("mean_n", "stdev_n")})


def histogram_sql(relation: str, col: str, bins: int) -> str:
    return f"""SELECT b.bin, {r(f'e.lo + b.bin * (e.hi - e.lo) / {bins}e0')} AS low, coalesce(c.n, 0) AS n
  FROM (SELECT unnest(range({bins})) AS bin) b,
  (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {relation}) e LEFT JOIN (
    SELECT CASE WHEN hi > lo THEN CAST(least(floor(({col} - lo) / ((hi - lo) / {bins}e0)), {bins - 1}) AS BIGINT) ELSE 0 END AS bin,
    count(*) AS n FROM {relation}, (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {relation})
    WHERE {col} IS NOT NULL GROUP BY 1) c ON b.bin = c.bin"""


@query("interaction_histogram", histogram_sql("counts", "n", 10), COUNTS)
def interaction_histogram(t):
    return I.histogram(t.counts, "n", 10).withColumn("low", rounded("low"))
