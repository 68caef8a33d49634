"""Projections, scalar functions and filters."""

from pyspark.sql import functions as F

from affinia.functions import scalars as S
from affinia.operators import quality
from affinia.operators.aggregates import mean_location
from affinia.operators.evaluation import count_where, residuals
from affinia.operators.interactions import interaction_counts
from affinia.operators.profiles import transform_businesses, transform_reviews, transform_users
from affinia.plans.registry import query, r

AS_OF = "2001-06-01"  # inside the review dates, so that the one-year floor is met

LEN = "CASE WHEN {0} = 'None' THEN 0 ELSE len(string_split({0}, ',')) END"
USER_COLUMNS = f"""
  user_id, average_stars, review_count AS user_review_count, fans, useful, funny, cool,
  useful + funny + cool AS num_interactions,
  CAST(2024 - CAST(string_split(yelping_since, '-')[1] AS INT) AS INT) AS yelping_since,
  CAST({LEN.format('friends')} AS INT) AS friends_count, CAST({LEN.format('elite')} AS INT) AS elite_years,
  compliment_hot + compliment_more + compliment_funny AS compliments, compliment_hot, compliment_more"""


@query("user_profile", f"SELECT {USER_COLUMNS} FROM users")
def user_profile(t):
    return transform_users(t.users)


@query("interaction_total", "SELECT user_id, useful + funny + cool AS num_interactions FROM users")
def interaction_total(t):
    return t.users.select("user_id", S.interaction_total("useful", "funny", "cool").alias("num_interactions"))


@query("account_age_years", "SELECT user_id, CAST(2024 - year(CAST(yelping_since AS DATE)) AS INT) AS years FROM users")
def account_age_years(t):
    return t.users.select("user_id", S.account_age("yelping_since").alias("years"))


@query("list_length", f"""SELECT user_id, CAST({LEN.format('friends')} AS INT) AS friends_count,
  CAST({LEN.format('elite')} AS INT) AS elite_years FROM users""")
def list_length(t):
    return t.users.select("user_id", S.csv_len("friends").alias("friends_count"), S.csv_len("elite").alias("elite_years"))


@query("compliment_total", "SELECT user_id, compliment_hot + compliment_more + compliment_funny AS compliments FROM users")
def compliment_total(t):
    return t.users.select("user_id", S.sum_prefix(t.users, "compliment_").alias("compliments"))


@query("business_profile", """SELECT business_id, stars AS bus_stars, review_count AS bus_review_count,
  categories, city, is_open FROM businesses""")
def business_profile(t):
    return transform_businesses(t.businesses)


@query("review_feedback", f"""SELECT review_id, user_id, business_id, stars, useful,
  cool + funny + useful AS ufc_count,
  {r(f"(cool + funny + useful) / greatest(date_diff('day', CAST(date AS DATE), DATE '{AS_OF}') / 365e0, 1e0)")}
    AS ufc_count_per_year FROM reviews""")
def review_feedback(t):
    return transform_reviews(t.reviews, AS_OF).withColumn("ufc_count_per_year", S.rounded("ufc_count_per_year"))


CLEAN = """replace(replace(replace(replace(replace(categories, '&', ' '), '/', ' '), '(', ''), ')', ''), '  ', '')"""
TOKENS = f"coalesce(list_transform(string_split({CLEAN}, ','), lambda x: lower(trim(x))), [])"


@query("category_tokens", f"""SELECT business_id, CAST(len({TOKENS}) AS INT) AS n_tokens,
  array_to_string({TOKENS}, '|') AS tokens FROM businesses""")
def category_tokens(t):
    tokens = S.clean_categories("categories")
    return t.places.select("business_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"))


@query("category_md5", f"""SELECT business_id, category, md5(category) AS category_md5
  FROM (SELECT business_id, unnest({TOKENS}) AS category FROM businesses)""")
def category_md5(t):
    tokens = t.places.select("business_id", F.explode(S.clean_categories("categories")).alias("category"))
    return tokens.withColumn("category_md5", F.md5("category"))


@query("split_categories_simple", """SELECT business_id, unnest(list_filter(list_distinct(
  string_split(coalesce(categories, ''), ', ')), lambda x: x <> '')) AS category FROM businesses""")
def split_categories_simple(t):
    return t.places.select("business_id", F.explode(S.split_categories("categories")).alias("category"))


@query("tag_ids", """SELECT DISTINCT user_id, business_id, user_id || '_uid' AS uid, business_id || '_bid' AS bid,
  business_id AS business_id_back FROM pairs""")
def tag_ids(t):
    bid = S.with_suffix("business_id", "_bid")
    return t.pairs.select(
        "user_id", "business_id", S.with_suffix("user_id", "_uid").alias("uid"), bid.alias("bid"),
        S.without_suffix(bid, "_bid").alias("business_id_back"),
    )


COUNTS = "counts AS (SELECT user_id, business_id, count(*) AS n FROM tips GROUP BY user_id, business_id)"
LOGN = "1 + 4 * (ln(n + 1) - ln(2)) / (ln(285) - ln(2))"
SCORED = f"{COUNTS}, scored AS (SELECT *, {LOGN} AS s FROM counts)"
INVERSE = "exp((s - 1) / 4 * (ln(285) - ln(2)) + ln(2)) - 1"


@query("log_affinity", f"SELECT user_id, business_id, n, {r(LOGN)} AS affinity FROM counts", COUNTS)
def log_affinity(t):
    return interaction_counts(t.tips).withColumn("affinity", S.rounded(S.log_affinity("n")))


@query("log1p_rating", f"SELECT user_id, business_id, n, {r('ln(1 + n)')} AS rating FROM counts", COUNTS)
def log1p_rating(t):
    return interaction_counts(t.tips).withColumn("rating", S.rounded(F.log1p("n")))


@query("inverse_log_affinity", f"SELECT user_id, business_id, n, {r(INVERSE)} AS back FROM scored", SCORED)
def inverse_log_affinity(t):
    return interaction_counts(t.tips).withColumn("back", S.rounded(S.inverse_log_affinity(S.log_affinity("n"))))


@query("affinity_magnify", f"""SELECT p.user_id, p.business_id, {r(f'coalesce(50 * ({INVERSE}), 0)', 4)} AS affinity_score
  FROM pairs p LEFT JOIN scored USING (user_id, business_id)""", SCORED)
def affinity_magnify(t):
    scores = interaction_counts(t.tips).select("user_id", "business_id", S.log_affinity("n").alias("s"))
    return t.pairs.join(scores, ["user_id", "business_id"], "left").select(
        "user_id", "business_id", S.rounded(S.magnified_affinity("s"), 4).alias("affinity_score")
    )


@query("clip_prediction", """SELECT user_id, business_id, greatest(least(prediction, 5), 1) AS clipped,
  least(prediction, 5) AS cut_at_five FROM predictions""")
def clip_prediction(t):
    return t.predictions.select(
        "user_id", "business_id", S.clip("prediction").alias("clipped"), S.clip("prediction", low=None).alias("cut_at_five")
    )


@query("round_prediction", """SELECT user_id, business_id, round_even(prediction, 0) AS half_even,
  floor(prediction + 0.5) AS half_up FROM predictions""")
def round_prediction(t):
    return t.predictions.select(
        "user_id", "business_id", S.round_stars("prediction").alias("half_even"),
        S.round_stars("prediction", "half_up").alias("half_up"),
    )


@query("truncate_prediction", """SELECT stage, CAST(trunc(v) AS INT) AS value, count(*) AS n FROM (
  SELECT 'original' AS stage, prediction AS v FROM predictions UNION ALL
  SELECT 'rounded', floor(prediction + 0.5) FROM predictions) GROUP BY ALL""")
def truncate_prediction(t):
    stages = F.array(
        F.struct(F.lit("original").alias("stage"), F.col("prediction").alias("v")),
        F.struct(F.lit("rounded").alias("stage"), S.round_stars("prediction", "half_up").alias("v")),
    )
    return (
        t.predictions.select(F.explode(stages).alias("x"))
        .groupBy("x.stage", F.col("x.v").cast("int").alias("value")).agg(F.count("*").alias("n"))
    )


BUCKET = """CASE WHEN prediction >= 0 AND prediction < 1.5 THEN '1-Star' WHEN prediction >= 1.5 AND prediction < 2.5 THEN '2-Star'
  WHEN prediction >= 2.5 AND prediction < 3.5 THEN '3-Star' WHEN prediction >= 3.5 AND prediction < 4.5 THEN '4-Star'
  WHEN prediction >= 4.5 AND prediction < 5.5 THEN '5-Star' END"""


@query("star_bucket", f"SELECT user_id, business_id, {BUCKET} AS bucket FROM predictions")
def star_bucket(t):
    return t.predictions.select("user_id", "business_id", S.star_bucket("prediction").alias("bucket"))


HOME = """visited AS (SELECT DISTINCT user_id, business_id FROM tips),
home AS (SELECT user_id, avg(latitude) AS ulat, avg(longitude) AS ulon
  FROM visited JOIN businesses USING (business_id) GROUP BY user_id)"""


def haversine_sql(lon1, lat1, lon2, lat2):
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"6371000 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"


@query("haversine_distance", f"""SELECT user_id, business_id, {r(haversine_sql('ulon', 'ulat', 'longitude', 'latitude'), 2)} AS metres
  FROM visited JOIN home USING (user_id) JOIN businesses USING (business_id)""", HOME)
def haversine_distance(t):
    located = t.tips.distinct().join(t.places.select("business_id", "latitude", "longitude"), "business_id")
    home = mean_location(located, "user_id").toDF("user_id", "ulat", "ulon")
    return located.join(home, "user_id").select(
        "user_id", "business_id", S.rounded(S.haversine("ulon", "ulat", "longitude", "latitude"), 2).alias("metres")
    )


@query("drop_columns", "SELECT business_id, stars, review_count, city, is_open FROM businesses")
def drop_columns(t):
    return t.businesses.drop("categories", "latitude", "longitude", "not_a_column")


@query("null_defaults", """SELECT u.user_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_tips FROM users u
  LEFT JOIN (SELECT user_id, count(*) AS n FROM tips GROUP BY user_id) t USING (user_id)""")
def null_defaults(t):
    tips = t.tips.groupBy("user_id").agg(F.count("*").alias("n_tips"))
    return t.users.select("user_id").join(tips, "user_id", "left").fillna({"n_tips": 0})


CHECKED = ["fans", "useful", "compliment_hot", "friends", "elite", "source"]


@query("constant_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) = 1 AS is_constant FROM tagged" for c in CHECKED),
    "tagged AS (SELECT *, 'user' AS source FROM users)")
def constant_columns(t):
    tagged = t.users.withColumn("source", F.lit("user")).select("user_id", *CHECKED)
    return quality.constant_columns(tagged, keep=("user_id",))


@query("isin_filter", "SELECT photo_id, business_id, label FROM photos WHERE label IN ('inside', 'outside')")
def isin_filter(t):
    return t.photos.where(F.col("label").isin("inside", "outside")).select("photo_id", "business_id", "label")


@query("range_filter", """SELECT 'two_to_three' AS filter_name, count(*) AS n FROM predictions WHERE prediction BETWEEN 2 AND 3
  UNION ALL SELECT 'within_half', count(*) FROM predictions WHERE abs(prediction - stars) <= 0.5
  UNION ALL SELECT 'low_and_high', count(*) FROM predictions WHERE stars <= 2 AND prediction >= 3""")
def range_filter(t):
    p, s = F.col("prediction"), F.col("stars")
    return count_where(
        t.predictions, two_to_three=p.between(2, 3), within_half=F.abs(p - s) <= 0.5, low_and_high=(s <= 2) & (p >= 3)
    )


@query("drop_null_text", """SELECT doc_id, trim(text) = '' AS is_blank, length(text) AS n_text
  FROM documents WHERE text IS NOT NULL""", plain=True)
def drop_null_text(t):
    return t.table("documents").dropna(subset=["text"]).select(
        "doc_id", (F.trim("text") == "").alias("is_blank"), F.length("text").cast("bigint").alias("n_text")
    )


@query("residuals", f"SELECT user_id, business_id, stars, prediction, {r('prediction - stars', 4)} AS error FROM predictions")
def residuals_query(t):
    return residuals(t.predictions).withColumn("error", S.rounded("error", 4))


WORDS = r"list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda x: x <> ''), lambda x: lower(x))"


@query("text_normalize", f"SELECT doc_id, array_to_string({WORDS}, ' ') AS normalized FROM documents WHERE text IS NOT NULL", plain=True)
def text_normalize(t):
    return t.table("documents").dropna(subset=["text"]).select("doc_id", S.normalized_text("text").alias("normalized"))
