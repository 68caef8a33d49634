"""Sources and sinks, as round trips through the shared folder."""

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from affinia.functions.scalars import clip, hash32, normalized_text, photo_path, rounded
from affinia.operators.profiles import transform_users
from affinia.operators.similarity import similar_businesses
from affinia.operators.transforms import split_edge
from affinia.plans.learning import linear_model, prepared
from affinia.plans.projections import USER_COLUMNS, WORDS
from affinia.plans.registry import h32, query, r
from affinia.plans.similarity import BANDS, CANDIDATES, GROUPS, THRESHOLD, edges
from affinia.session import scratch_path
from affinia.sources import files, schemas


def jsonl(t):
    """Tips as JSON lines, with a broken line for every business."""
    lines = t.tips.select(F.to_json(F.struct("user_id", "business_id")).alias("value"))
    broken = t.places.select(F.concat(F.lit('{"user_id": "'), "business_id").alias("value"))
    path = scratch_path(t.spark, "tips-jsonl")
    files.write_text(lines.unionByName(broken), path, "value")
    return path


@query("read_jsonl", "SELECT user_id, business_id FROM tips")
def read_jsonl(t):
    return files.read_jsonl(t.spark, jsonl(t), schemas.TIPS)


@query("malformed_lines", """SELECT '{"user_id": "' || business_id AS line FROM businesses""")
def malformed_lines(t):
    return files.malformed_lines(t.spark, jsonl(t), schemas.TIPS)


@query("read_json_limited")
def read_json_limited(t):
    """The first 1000 records: the limit is the feature."""
    return files.read_jsonl(t.spark, jsonl(t), schemas.TIPS, limit=1000)


@query("read_pairs_csv", "SELECT user_id, business_id, stars FROM pairs")
def read_pairs_csv(t):
    path = scratch_path(t.spark, "pairs-csv")
    files.write_csv(t.pairs, path)
    return files.read_csv(t.spark, path, schemas.PAIRS)


@query("cached_csv", f"SELECT {USER_COLUMNS} FROM users")
def cached_csv(t):
    """A parsed frame kept as a typed table."""
    path = scratch_path(t.spark, "user-table")
    files.write_table(transform_users(t.users), path)
    return files.read_table(t.spark, path)


@query("write_predictions", "SELECT user_id, business_id, greatest(least(prediction, 5), 1) AS prediction FROM predictions")
def write_predictions(t):
    path = scratch_path(t.spark, "predictions-csv")
    files.write_csv(t.predictions.select("user_id", "business_id", clip("prediction").alias("prediction")), path)
    return files.read_csv(t.spark, path, schemas.PREDICTIONS)


@query("write_similar_pairs", f"""SELECT business_id_1, business_id_2, {r('similarity')} AS similarity FROM (
  SELECT * FROM jac JOIN candidates USING (business_id_1, business_id_2) WHERE similarity >= {THRESHOLD} UNION ALL SELECT * FROM copies)""",
       f"{BANDS}, {GROUPS}, {CANDIDATES}")
def write_similar_pairs(t):
    path = scratch_path(t.spark, "similar-csv")
    files.write_csv(similar_businesses(edges(t), THRESHOLD), path, "business_id_1", "business_id_2")
    return files.read_csv(t.spark, path, schemas.SIMILAR_PAIRS).withColumn("similarity", rounded("similarity"))


@query("save_text", f"SELECT array_to_string({WORDS}, ' ') AS value FROM documents WHERE text IS NOT NULL", plain=True)
def save_text(t):
    """Normalised texts to a text folder and back, a line per text."""
    path = scratch_path(t.spark, "texts")
    texts = t.table("documents").dropna(subset=["text"]).select(normalized_text("text").alias("value"))
    files.write_text(texts, path, "value")
    return files.read_text(t.spark, path)


@query("list_images", "SELECT photo_id, 'photos/' || photo_id || '.jpg' AS path FROM photos")
def list_images(t):
    return t.photos.select("photo_id", photo_path("photo_id").alias("path"))


@query("combine_pair_files", "SELECT user_id, business_id, stars FROM pairs")
def combine_pair_files(t):
    """Pairs written as a train and a validation file, then combined."""
    late = hash32("user_id", "business_id") % 5 == 0
    parts = []
    for name, rows in (("train", t.pairs.where(~late)), ("val", t.pairs.where(late))):
        path = scratch_path(t.spark, f"pairs-{name}")
        files.write_csv(rows, path)
        parts.append(files.read_csv(t.spark, path, schemas.PAIRS))
    return files.combine_pairs(*parts)


@query("model_store", f"""SELECT count(*) AS n, 0e0 AS largest_difference FROM pairs
  WHERE {h32('42', 'user_id', 'business_id')} >= {split_edge(0.8)}""")
def model_store(t):
    """A fitted model saved and loaded scores the test pairs as before."""
    _, train, test = prepared(t)
    model = linear_model(train)
    path = scratch_path(t.spark, "model")
    files.save_model(model, path)
    loaded = files.load_model(path, LinearRegressionModel).setPredictionCol("again")
    both = loaded.transform(model.transform(test))
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("prediction") - F.col("again"))).alias("largest_difference"))
