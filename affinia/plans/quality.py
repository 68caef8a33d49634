"""Data-quality checks."""

from pyspark.sql import functions as F

from affinia.functions.scalars import rounded
from affinia.operators import quality as Q
from affinia.operators.aggregates import union_all
from affinia.operators.factors import complete_vectors
from affinia.operators.interactions import decode_ids, index_ids, interaction_counts
from affinia.plans.factorization import VECTORS, user_vectors
from affinia.plans.aggregations import DIM
from affinia.plans.interactions import ROUTES, USER_INDEX
from affinia.plans.joins import features
from affinia.plans.projections import COUNTS
from affinia.plans.registry import query, r


@query("row_count_preserved", """SELECT count(*) AS n_before, count(*) AS n_after, true AS preserved FROM pairs""")
def row_count_preserved(t):
    return Q.row_counts(t.pairs, features(t))


KEYS = {"reviews": ["review_id"], "pairs": ["user_id", "business_id"], "photos": ["photo_id"], "tips": ["user_id", "business_id"]}


@query("key_uniqueness", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(DISTINCT ({', '.join(k)})) AS n_keys FROM {n}" for n, k in KEYS.items()))
def key_uniqueness(t):
    return union_all([Q.uniqueness(getattr(t, name), key, name) for name, key in KEYS.items()])


@query("unknown_ids", """SELECT 'user_id' AS column_name, count(*) FILTER (i.idx IS NULL) AS n_unknown, count(*) AS n_rows
  FROM pairs p LEFT JOIN user_index i USING (user_id)""", USER_INDEX)
def unknown_ids(t):
    index = index_ids(t.tips, "user_id")
    coded = t.pairs.join(index, "user_id", "left").select("business_id", F.coalesce("idx", F.lit(-1)).alias("idx"))
    return Q.unknown_rows(decode_ids(coded, index, "idx", "user_id"), ["user_id"])


@query("default_vector_count", """SELECT count(*) AS n_vectors, count(*) FILTER (v.user_id IS NULL) AS n_zero, CAST(0 AS BIGINT) AS n_null
  FROM (SELECT DISTINCT user_id FROM pairs) p LEFT JOIN user_vec v USING (user_id)""", VECTORS)
def default_vector_count(t):
    return Q.default_vector_counts(complete_vectors(t.pairs, "user_id", user_vectors(t), DIM))


@query("score_coverage", """SELECT user_id, count(*) AS n_scores, (SELECT count(*) FROM businesses) AS n_expected FROM counts
  GROUP BY user_id HAVING count(*) <> (SELECT count(*) FROM businesses)""", COUNTS)
def score_coverage(t):
    return Q.coverage(interaction_counts(t.tips), t.table("supplier").agg(F.count("*")).scalar())


@query("cold_start_report", f"""SELECT user_known, business_known, count(*) AS n, {r('count(*) / (SELECT count(*) FROM pairs)')} AS share
  FROM routes GROUP BY ALL""", ROUTES)
def cold_start_report(t):
    return Q.cold_start(t.shared().pairs, t.counts, t.counts).withColumn("share", rounded("share"))
