"""Regressors, searches, classifier and importances."""

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from affinia.functions.scalars import hash32
from affinia.operators import models as M
from affinia.operators.evaluation import confusion, rmse_of
from affinia.operators.interactions import label_encode
from affinia.operators.joins import attach_cluster
from affinia.operators.segments import size_tiers
from affinia.operators.transforms import hash_split, stratified_split
from affinia.plans.joins import features, rule_clusters
from affinia.plans.registry import h32, query
from affinia.session import materialise

NAMES = [
    "score", "affinity_score", "average_stars", "user_review_count", "fans", "useful", "num_interactions",
    "bus_stars", "bus_review_count", "is_open",
]
FOLDS = 5
SPACE = {"maxDepth": (3, 7), "stepSize": (0.01, 0.3)}


def split_features(t):
    """Feature rows, written once, with an 80/20 split by key."""
    rows = features(t).select("user_id", "business_id", "stars", *NAMES)
    return hash_split(materialise(rows, "features"), ["user_id", "business_id"], {"train": 0.8, "test": 0.2})


def train_test(t):
    rows = split_features(t)
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


def prepared(t):
    train, test = train_test(t)
    spec = M.FeatureSpec.fit(train, NAMES)
    return spec, spec.apply(train), spec.apply(test)


@query("rating_regressor")
def rating_regressor(t):
    """Predictions of the global boosted trees for the test pairs, in [1, 5]."""
    spec, train, test = prepared(t)
    scored = M.fit_gbt(train).transform(test)
    return scored.select("user_id", "business_id", "stars", M.clip("prediction").alias("prediction"))


@query("rating_regressor_rmse")
def rating_regressor_rmse(t):
    """RMSE of the global trees next to that of the training mean."""
    spec, train, test = prepared(t)
    mean = train.agg(F.avg("stars")).scalar()
    scored = M.fit_gbt(train).transform(test).withColumn("mean", mean)
    return scored.agg(F.count("*").alias("n"), rmse_of("prediction").alias("rmse"), rmse_of("mean").alias("rmse_of_mean"))


def cluster_models(t):
    train, test = (attach_cluster(part, rule_clusters(t)) for part in train_test(t))
    tiers = {row["Cluster"]: row["tier"] for row in size_tiers(train).where("Cluster is not null").collect()}  # a row per cluster
    return M.fit_by_cluster(train, NAMES, tiers), test


@query("cluster_regressors")
def cluster_regressors(t):
    """Predictions by the model of the user's cluster, one RMSE per cluster."""
    models, test = cluster_models(t)
    return M.predict_clip(models, test).groupBy("Cluster").agg(F.count("*").alias("n"), rmse_of("prediction").alias("rmse"))


@query("predict_clip")
def predict_clip(t):
    """Union of the clusters' predictions with the fallback: every test pair once, in [1, 5]."""
    models, test = cluster_models(t)
    return M.predict_clip(models, test).select("user_id", "business_id", "stars", "prediction")


@query("early_stopping")
def early_stopping(t):
    """Trees kept when the held-out rows have not improved for 10 rounds, and their RMSE."""
    spec, train, test = prepared(t)
    flagged = train.withColumn("held_out", hash32(F.lit("stop"), "user_id", "business_id") % 5 == 0)
    model = M.fit_until_flat(flagged, "held_out")
    return model.transform(test).agg(rmse_of("prediction").alias("rmse")).withColumn("trees", F.lit(model.getNumTrees))


@query("stacked_regressor")
def stacked_regressor(t):
    train, test = train_test(t)
    predict = M.fit_stack(train, NAMES, folds=FOLDS)
    return predict(test).agg(F.count("*").alias("n"), rmse_of("prediction").alias("rmse"))


def search_rows(t):
    spec, train, _ = prepared(t)
    return train.select("stars", "features")


@query("grid_search")
def grid_search(t):
    return M.grid_search(M.gbt(), search_rows(t), {"maxDepth": [4, 5, 6], "stepSize": [0.05, 0.1, 0.2]}, folds=FOLDS)[1]


@query("random_search")
def random_search(t):
    return M.random_search(M.gbt(), search_rows(t), SPACE, n=10, folds=FOLDS)[1]


@query("sequential_search")
def sequential_search(t):
    return M.refine_search(M.gbt(), search_rows(t), SPACE, rounds=3, folds=FOLDS)[1]


def photo_predictions(t, labels: list[str] | None = None):
    photos = t.photos if labels is None else t.photos.where(F.col("label").isin(labels))
    coded = label_encode(photos.withColumn("features", array_to_vector("embedding")).drop("embedding"), "label", "code")
    split = stratified_split(coded.withColumn("code", F.col("code").cast("double")), "label", "photo_id", 0.8)
    model = M.fit_label(split.where("split = 'train'"), "code")
    return model.transform(split.where("split = 'test'")).select("photo_id", "label", "code", "prediction")


@query("photo_classifier")
def photo_classifier(t):
    """Five-class predictions for the held-out photos."""
    return photo_predictions(t)


@query("photo_five_way_confusion")
def photo_five_way_confusion(t):
    return confusion(photo_predictions(t), "code", "prediction")


@query("photo_confusion")
def photo_confusion(t):
    """Confusion of the two-class variant."""
    return confusion(photo_predictions(t, ["inside", "outside"]), "code", "prediction")


@query("feature_importance")
def feature_importance(t):
    spec, train, _ = prepared(t)
    return M.importances(M.fit_gbt(train), spec)


@query("permutation_importance")
def permutation_importance(t):
    train, test = train_test(t)
    spec = M.FeatureSpec.fit(train, NAMES)
    return M.permutation_importance(M.fit_gbt(spec.apply(train)), spec, test)


def linear_model(train):
    return LinearRegression(labelCol="stars", regParam=0.01).fit(train)
