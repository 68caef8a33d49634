"""Rankings, sorts, limits, samples and splits."""

from pyspark.sql import functions as F

from affinia.operators import transforms as X
from affinia.operators.interactions import interaction_counts, top_k, top_k_per
from affinia.operators.quality import duplicates
from affinia.operators.ranking import rank_of
from affinia.plans.projections import COUNTS
from affinia.plans.registry import h32, query

K = 10


@query("top_k_overall", "SELECT user_id, business_id, n FROM counts ORDER BY n DESC, user_id, business_id LIMIT 20", COUNTS)
def top_k_overall(t):
    return top_k(interaction_counts(t.tips), "n", 20, "user_id", "business_id")


@query("top_k_per_user", f"""SELECT user_id, business_id, prediction, CAST(rank AS INT) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, business_id) AS rank FROM predictions) WHERE rank <= {K}""")
def top_k_per_user(t):
    return top_k_per(t.predictions, ["user_id"], [F.desc("prediction"), "business_id"], K).drop("stars")


@query("first_row_per_key", """SELECT user_id, review_id, business_id, stars, date FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) AS rn FROM reviews) WHERE rn = 1""")
def first_row_per_key(t):
    rows = t.reviews.select("user_id", "review_id", "business_id", "stars", "date")
    return X.first_per(rows, "user_id", ["date", "review_id"])


@query("global_sort", "SELECT user_id, business_id, prediction FROM predictions ORDER BY prediction DESC, user_id, business_id")
def global_sort(t):
    return t.predictions.select("user_id", "business_id", "prediction").orderBy(F.desc("prediction"), "user_id", "business_id")


@query("limit_rows", "SELECT review_id, stars FROM reviews ORDER BY review_id LIMIT 100")
def limit_rows(t):
    return t.reviews.select("review_id", "stars").orderBy("review_id").limit(100)


@query("sample_rows", f"SELECT doc_id, lang FROM documents ORDER BY {h32('42', 'doc_id')}, doc_id LIMIT 100", plain=True)
def sample_rows(t):
    return X.sample_n(t.table("documents").select("doc_id", "lang"), "doc_id", 100)


U = h32("42", "user_id", "business_id")


@query("random_split", f"""SELECT user_id, business_id, CASE WHEN {U} < {X.split_edge(0.8)} THEN 'train' ELSE 'test' END AS split FROM pairs""")
def random_split(t):
    return X.hash_split(t.pairs, ["user_id", "business_id"], {"train": 0.8, "test": 0.2}).drop("stars")


@query("random_split_builtin")
def random_split_builtin(t):
    """Spark's own randomSplit: sizes only, the rows depend on the partitioning."""
    parts = t.pairs.randomSplit([0.8, 0.2], 42)
    named = [p.withColumn("split", F.lit(n)) for p, n in zip(parts, ("train", "test"))]
    return named[0].unionByName(named[1]).groupBy("split").agg(F.count("*").alias("n"))


@query("stratified_split", f"""SELECT photo_id, label, CASE WHEN row_number() OVER (PARTITION BY label
  ORDER BY {h32('42', 'photo_id')}, photo_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8e0 + 0.5e0)
  THEN 'train' ELSE 'test' END AS split FROM photos""")
def stratified_split(t):
    return X.stratified_split(t.photos.select("photo_id", "label"), "label", "photo_id", 0.8)


@query("rank_in_list", f"""SELECT user_id, business_id, CASE WHEN rank <= {K} THEN CAST(rank AS INT) END AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, business_id) AS rank FROM predictions)
  WHERE (user_id, business_id) IN (SELECT user_id, business_id FROM tips)""")
def rank_in_list(t):
    ranked = top_k_per(t.predictions, ["user_id"], [F.desc("prediction"), "business_id"], K)
    return rank_of(ranked, t.tips.distinct())


@query("duplicate_keys", """SELECT review_id, l.user_id, l.business_id, copies FROM reviews l
  JOIN (SELECT user_id, business_id, count(*) AS copies FROM reviews GROUP BY ALL HAVING count(*) > 1) d
  ON l.user_id = d.user_id AND l.business_id = d.business_id""")
def duplicate_keys(t):
    return duplicates(t.reviews.select("review_id", "user_id", "business_id"), ["user_id", "business_id"])
