"""Evaluation and error structure of the fixed predictor."""

from pyspark.sql import functions as F

from affinia.functions.scalars import rounded, star_bucket
from affinia.operators import evaluation as E
from affinia.operators.aggregates import avg_useful, profile, union_all
from affinia.operators.interactions import histogram, histogram2d
from affinia.plans.aggregations import profile_sql, rounded_profile
from affinia.plans.interactions import histogram_sql
from affinia.plans.joins import CLUSTERS, rule_clusters
from affinia.plans.projections import BUCKET
from affinia.plans.registry import query, r

RMSE = "sqrt(avg((prediction - stars) * (prediction - stars)))"


@query("rmse", f"""SELECT count(*) AS n, {r('sqrt(avg((p.prediction - t.stars) * (p.prediction - t.stars)))')} AS rmse
  FROM pairs t JOIN predictions p USING (user_id, business_id)""")
def rmse(t):
    return E.rmse(t.predictions.drop("stars"), t.pairs).withColumn("rmse", rounded("rmse"))


@query("rmse_by_cluster", f"""SELECT 'group' AS scope, "Cluster", count(*) AS n, {r(RMSE)} AS rmse FROM predictions JOIN clusters USING (user_id)
  GROUP BY "Cluster" UNION ALL SELECT 'overall', NULL, count(*), {r(RMSE)} FROM predictions JOIN clusters USING (user_id)""", CLUSTERS)
def rmse_by_cluster(t):
    return E.rmse_by(t.predictions.join(rule_clusters(t), "user_id"), "Cluster").withColumn("rmse", rounded("rmse"))


VARIANTS = {
    "raw": "prediction", "clipped": "greatest(least(prediction, 5), 1)", "rounded": "round_even(prediction, 0)",
    "cut_at_five": "least(prediction, 5)",
}


@query("rmse_variants", " UNION ALL ".join(
    f"SELECT '{n}' AS variant, {r(f'sqrt(avg(({e} - stars) * ({e} - stars)))')} AS rmse FROM predictions" for n, e in VARIANTS.items()))
def rmse_variants(t):
    return E.rmse_variants(t.predictions).withColumn("rmse", rounded("rmse"))


@query("confusion_matrix", f"""SELECT label, predicted, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY label)')} AS share
  FROM (SELECT CAST(floor(stars + 0.5) AS BIGINT) AS label, coalesce({BUCKET}, 'outside') AS predicted FROM predictions) GROUP BY label, predicted""")
def confusion_matrix(t):
    rows = t.predictions.select(
        F.floor(F.col("stars") + 0.5).alias("label"), F.coalesce(star_bucket("prediction"), F.lit("outside")).alias("predicted")
    )
    return E.confusion(rows, "label", "predicted").withColumn("share", rounded("share"))


def with_error(t):
    return t.scored.select(F.floor("stars").alias("star"), (F.col("prediction") - F.col("stars")).alias("error"))


@query("error_by_star", profile_sql("errors", ["star"], ["error"]),
       "errors AS (SELECT CAST(floor(stars) AS BIGINT) AS star, prediction - stars AS error FROM predictions)")
def error_by_star(t):
    return rounded_profile(profile(with_error(t), ["star"], ["error"]))


@query("star_confusion", f"""SELECT s.stars, b.bucket, coalesce(c.n, 0) AS n FROM (SELECT unnest([1e0, 2e0, 3e0, 4e0, 5e0]) AS stars) s
  CROSS JOIN (SELECT unnest(['1-Star', '2-Star', '3-Star', '4-Star', '5-Star']) AS bucket) b
  LEFT JOIN (SELECT stars, {BUCKET} AS bucket, count(*) AS n FROM predictions GROUP BY ALL) c ON c.stars = s.stars AND c.bucket = b.bucket""")
def star_confusion(t):
    return E.star_confusion(t.predictions)


OVER = """over_rows AS (SELECT *, round_even(prediction, 0) AS rounded_prediction FROM predictions
  WHERE stars IN (1, 2) AND round_even(prediction, 0) >= 3)"""


@query("overpredicted_lows", "SELECT * FROM over_rows", OVER)
def overpredicted_lows(t):
    return E.overpredicted(t.predictions)


FEATS = """feats AS (SELECT p.user_id, p.business_id, u.average_stars, b.stars AS bus_stars, b.city, a.avg_useful_score
  FROM pairs p LEFT JOIN users u USING (user_id) LEFT JOIN businesses b USING (business_id)
  LEFT JOIN (SELECT business_id, avg(useful) AS avg_useful_score FROM reviews GROUP BY business_id) a USING (business_id)),
over_feats AS (SELECT o.*, f.average_stars, f.bus_stars, f.city, f.avg_useful_score FROM over_rows o JOIN feats f USING (user_id, business_id))"""


def over_features(t):
    t.shared()
    feats = (
        t.pairs.drop("stars").join(t.users.select("user_id", "average_stars"), "user_id", "left")
        .join(t.businesses.select("business_id", F.col("stars").alias("bus_stars"), "city"), "business_id", "left")
        .join(avg_useful(t.reviews), "business_id", "left")
    )
    return E.error_features(
        E.overpredicted(t.predictions), feats, ["average_stars", "bus_stars", "city", "avg_useful_score"]
    )


@query("error_feature_join", f"SELECT * REPLACE ({r('avg_useful_score')} AS avg_useful_score) FROM over_feats", f"{OVER}, {FEATS}", inline=True)
def error_feature_join(t):
    return over_features(t).withColumn("avg_useful_score", rounded("avg_useful_score"))


def box_sql(relation: str, value: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, {r('any_value(q1)')} AS q1, {r('any_value(q2)')} AS median, {r('any_value(q3)')} AS q3,
  {r(f'min({value}) FILTER ({value} BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1))')} AS whisker_low,
  {r(f'max({value}) FILTER ({value} BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1))')} AS whisker_high
  FROM {relation} JOIN (SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
    quantile_cont({value}, 0.75) AS q3 FROM {relation} GROUP BY {by}) USING ({by}) GROUP BY {by}"""


CITY = "city_predictions AS (SELECT p.*, b.city FROM predictions p JOIN businesses b USING (business_id))"


def city_predictions(t):
    return t.scored.join(t.places.select("business_id", "city"), "business_id")


@query("feature_box_stats", box_sql("city_predictions", "prediction", "city"), CITY)
def feature_box_stats(t):
    stats = E.box_stats(city_predictions(t), "prediction", "city")
    return stats.withColumns({c: rounded(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@query("error_filters", """SELECT 'user_mean' AS filter_name, count(*) AS n FROM over_feats WHERE average_stars >= 3 AND prediction >= 2
  UNION ALL SELECT 'business_mean', count(*) FROM over_feats WHERE bus_stars >= 2.5 AND prediction >= 2
  UNION ALL SELECT 'usefulness', count(*) FROM over_feats WHERE avg_useful_score >= 4 AND prediction >= 3""", f"{OVER}, {FEATS}")
def error_filters(t):
    p = F.col("prediction")
    return E.count_where(
        over_features(t), user_mean=(F.col("average_stars") >= 3) & (p >= 2),
        business_mean=(F.col("bus_stars") >= 2.5) & (p >= 2), usefulness=(F.col("avg_useful_score") >= 4) & (p >= 3),
    )


@query("city_error_counts", f"SELECT city, count(*) AS n, {r(RMSE)} AS rmse FROM over_rows JOIN businesses USING (business_id) GROUP BY city".replace("stars)", "over_rows.stars)"), OVER)
def city_error_counts(t):
    return E.city_errors(E.overpredicted(city_predictions(t))).withColumn("rmse", rounded("rmse"))


@query("city_overrepresentation", f"""SELECT city, n_businesses, n_errors, {r('es')} AS error_share, {r('bs')} AS business_share, {r('es / bs')} AS lift FROM (
  SELECT b.city, b.n AS n_businesses, coalesce(e.n, 0) AS n_errors, coalesce(e.n, 0) / nullif((SELECT count(*) FROM over_rows), 0) AS es,
    b.n / (SELECT count(*) FROM businesses) AS bs
  FROM (SELECT city, count(*) AS n FROM businesses GROUP BY city) b
  LEFT JOIN (SELECT city, count(*) AS n FROM over_rows JOIN businesses USING (business_id) GROUP BY city) e USING (city))""", OVER)
def city_overrepresentation(t):
    lift = E.city_lift(E.overpredicted(city_predictions(t)), t.places)
    return lift.withColumns({c: rounded(c) for c in ("error_share", "business_share", "lift")})


CHOSEN = ["CHINA", "FRANCE", "PERU"]
LISTED = ", ".join(f"'{c}'" for c in CHOSEN)


def parted_sql(part: str, condition: str, col: str, bins: int) -> str:
    relation = f"(SELECT * FROM city_predictions WHERE {condition})"
    return f"SELECT '{part}' AS part, '{col}' AS col, * FROM ({histogram_sql(relation, col, bins)})"


@query("prediction_histogram", " UNION ALL ".join(
    parted_sql(part, f"city {test} ({LISTED})", col, 30) for part, test in (("chosen", "IN"), ("rest", "NOT IN")) for col in ("prediction", "stars")), CITY)
def prediction_histogram(t):
    rows = city_predictions(t)
    parts = {"chosen": F.col("city").isin(CHOSEN), "rest": ~F.col("city").isin(CHOSEN)}
    return union_all([
        histogram(rows.where(test), col, 30).select(F.lit(part).alias("part"), F.lit(col).alias("col"), "bin", rounded("low").alias("low"), "n")
        for part, test in parts.items() for col in ("prediction", "stars")
    ])


@query("joint_histogram", """SELECT CAST(least(floor((prediction - x0) / ((x1 - x0) / 20e0)), 19) AS BIGINT) AS x_bin,
  CAST(least(floor((stars - y0) / ((y1 - y0) / 5e0)), 4) AS BIGINT) AS y_bin, count(*) AS n FROM predictions,
  (SELECT min(prediction) AS x0, max(prediction) AS x1, min(stars) AS y0, max(stars) AS y1 FROM predictions) GROUP BY 1, 2""")
def joint_histogram(t):
    return histogram2d(t.scored, "prediction", "stars", 20, 5)


@query("rating_distribution", """SELECT 'true' AS kind, round_even(stars, 0) AS star, count(*) AS n FROM predictions GROUP BY 2
  UNION ALL SELECT 'predicted', round_even(prediction, 0), count(*) FROM predictions GROUP BY 2""")
def rating_distribution(t):
    return union_all([
        E.value_counts(t.scored, F.rint(col), "star").select(F.lit(kind).alias("kind"), "star", "n")
        for kind, col in (("true", "stars"), ("predicted", "prediction"))
    ])
