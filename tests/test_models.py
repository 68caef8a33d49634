"""Invariants of the learners, and of sources and audits around them."""

import os

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from affinia.functions.vectors import zeros
from affinia.operators import aggregates as A
from affinia.operators import boosting
from affinia.operators import factors as M
from affinia.operators import models as R
from affinia.operators import quality as Q
from affinia.operators import segments as C
from affinia.operators import transforms as X
from affinia.operators import trials
from affinia.operators.evaluation import rmse_of
from affinia.operators.interactions import histogram, implicit_ratings, index_ids, interaction_counts
from affinia.operators.joins import feature_rows
from affinia.session import scratch_path
from affinia.sources import files, schemas


@pytest.fixture(scope="module")
def tips(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{u}", f"b{(u % 4) * 5 + int(rng.integers(0, 5))}") for u in range(40) for _ in range(6)]
    return spark.createDataFrame(rows, "user_id string, business_id string")


def test_als_invariants(spark, tips):
    users, businesses = index_ids(tips, "user_id"), index_ids(tips, "business_id")
    ratings = implicit_ratings(interaction_counts(tips), users, businesses).persist()
    model = M.fit_als(ratings, rank=4, reg=0.1, alpha=40.0, max_iter=5, blocks=2)
    uv, bv = M.factors(model, users, businesses)
    assert all(len(r.features) == 4 and min(r.features) >= 0 for r in uv.collect())
    pairs = interaction_counts(tips).select("user_id", "business_id").unionByName(
        spark.createDataFrame([("cold", "b1"), ("cold", "b1")], "user_id string, business_id string")
    )
    scored = M.score_pairs(pairs, uv, bv)
    assert [tuple(r) for r in scored.where("user_id = 'cold'").collect()] == [("cold", "b1", 1.0, "default")]
    mine = scored.join(users.toDF("user_id", "user"), "user_id").join(businesses.toDF("business_id", "business"), "business_id")
    own = model.transform(ratings).select("user", "business", "prediction")
    gap = mine.join(own, ["user", "business"]).agg(F.max(F.abs(F.col("score") - F.col("prediction")))).first()[0]
    assert gap < 1e-4
    completed = M.complete_vectors(pairs, "user_id", uv, 4)
    assert completed.count() == 41 and completed.where("is_default").select("features").first()[0] == [0.0] * 4
    assert M.score_all(model, 3).groupBy("user").count().where("count <> 3").count() == 0


def test_tune_als_log(spark, tips):
    ratings = implicit_ratings(interaction_counts(tips), index_ids(tips, "user_id"), index_ids(tips, "business_id")).persist()
    _, log = M.tune_als(ratings, {"rank": [2, 3], "reg": [0.1, 1.0]}, max_iter=2, blocks=2)
    assert log.count() == 4 and log.where("rmse > 0").count() == 4


def test_feature_rows_keep_every_pair(spark):
    pairs = spark.createDataFrame([("u1", "b1", 4.0), ("u2", "b1", 3.0), ("u9", "b9", 1.0)], schemas.PAIRS)
    scores = spark.createDataFrame([("u1", "b1", 1.0), ("u1", "b1", 1.0)], "user_id string, business_id string, score double")
    users = spark.createDataFrame([("u1", 5)], "user_id string, fans int")
    places = spark.createDataFrame([("b1", "x", "y")], "business_id string, categories string, city string")
    rows = {r.user_id: r for r in feature_rows(pairs, scores, users, places).collect()}
    assert len(rows) == 3 and "city" not in rows["u1"]
    assert rows["u1"].affinity_score == pytest.approx(50.0) and rows["u2"].affinity_score == 0.0
    assert (rows["u1"].score_source, rows["u2"].score_source, rows["u9"].fans) == ("model", "absent", None)


@pytest.fixture(scope="module")
def rated(spark):
    """A planted signal, gaps in one column, a column that is never filled, clusters with a null."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b = (float(x) for x in rng.normal(size=2))
        stars = float(np.clip(3 + a - 0.5 * b + rng.normal(scale=0.2), 1, 5))
        rows.append((f"u{i}", f"b{i % 9}", stars, a, None if i % 7 == 0 else b, None, [0, 1, None][i % 3]))
    return spark.createDataFrame(
        rows, "user_id string, business_id string, stars double, a double, b double, c double, Cluster int"
    ).persist()


NAMES = ["a", "b", "c"]


def rmse(df):
    d = F.col("prediction") - F.col("stars")
    return df.agg(F.sqrt(F.avg(d * d))).first()[0]


def test_trees_beat_the_mean(rated):
    spec = R.FeatureSpec.fit(rated, NAMES)
    assert spec.flagged == ["b", "c"] and spec.columns == ["a", "b", "c", "b_missing", "c_missing"]
    model = R.fit_gbt(spec.apply(rated), {"maxIter": 5, "maxDepth": 3})
    assert rmse(model.transform(spec.apply(rated))) < 0.7 * rated.agg(F.stddev_pop("stars")).first()[0]
    assert R.importances(model, spec).first().feature == "a"
    rise = {r.feature: r.rise for r in R.permutation_importance(model, spec, rated).collect()}
    assert rise["a"] > rise["b"] > 0 and rise["c"] == pytest.approx(0)


def test_cluster_models_and_fallback(rated):
    small = {"large": {"maxIter": 2, "maxDepth": 2}, "small": {"maxIter": 2, "maxDepth": 2}}
    models = R.fit_by_cluster(rated, NAMES, {0: "large", 1: "small"}, tier_params=small)
    assert R.predict_clip(models, rated).count() == 600
    assert R.predict_clip(models, rated, fallback=False).count() == 400
    assert R.predict_clip(models, rated).where("prediction not between 1 and 5").count() == 0


def test_registered_cluster_fits_use_the_tier_settings(rated, monkeypatch):
    from affinia.plans import learning

    used = []
    monkeypatch.setattr(R, "fit_gbt", lambda rows, params, seed: used.append(params))
    monkeypatch.setattr(learning, "NAMES", NAMES)
    monkeypatch.setattr(learning, "train_test", lambda t: (rated, rated))
    monkeypatch.setattr(learning, "rule_clusters", lambda t: None)
    monkeypatch.setattr(learning, "attach_cluster", lambda part, clusters: part)
    learning.cluster_models(None)
    assert used == [R.TIER_PARAMS["small"], R.TIER_PARAMS["small"], R.TIER_PARAMS["large"]]


def test_early_stopping_waits_for_a_late_best_round(rated, monkeypatch):
    """The best round is found although the rounds before it were flat for less than the patience."""
    class Fitted:
        def __init__(self, trees):
            self.getNumTrees = trees

        def evaluateEachIteration(self, rows, loss):
            return [1.0 - 0.01 * min(i // 6 * 6, 54) for i in range(self.getNumTrees)]

    fits = []
    monkeypatch.setattr(R, "fit_gbt", lambda rows, params, seed: fits.append(params["maxIter"]) or Fitted(params["maxIter"]))
    monkeypatch.setattr(R, "first_trees", lambda model, n: Fitted(n))
    flagged = rated.withColumn("held", F.col("stars") > 4)
    assert R.fit_until_flat(flagged, "held").getNumTrees == 55 and fits == [40, 80]
    assert R.fit_until_flat(flagged, "held", limit=50).getNumTrees == 49
    assert R.fit_until_flat(flagged, "held", patience=4).getNumTrees == 1


def test_early_stopping_repeats_few_rounds_while_the_error_falls(rated, monkeypatch):
    """An error that falls without a pause is followed by one fit of all rounds, with the trees that doubled fits end at."""
    class Fitted:
        def __init__(self, trees):
            self.getNumTrees = trees

        def evaluateEachIteration(self, rows, loss):
            return [1.0 - 0.001 * min(i, 429) for i in range(self.getNumTrees)]

    fits = []
    monkeypatch.setattr(R, "fit_gbt", lambda rows, params, seed: fits.append(params["maxIter"]) or Fitted(params["maxIter"]))
    monkeypatch.setattr(R, "first_trees", lambda model, n: Fitted(n))
    flagged = rated.withColumn("held", F.col("stars") > 4)
    assert R.fit_until_flat(flagged, "held").getNumTrees == 430 and fits == [40, 480]


def test_registered_learners_use_full_settings(rated, monkeypatch):
    from affinia.plans import factorization, learning

    seen = {}

    class Seen(Exception):
        pass

    def record(name):
        def stop(*args, **kwargs):
            seen[name] = (args, kwargs)
            raise Seen
        return stop

    spec = R.FeatureSpec.fit(rated, NAMES)
    monkeypatch.setattr(learning, "NAMES", NAMES)
    monkeypatch.setattr(learning, "train_test", lambda t: (rated, rated))
    monkeypatch.setattr(learning, "prepared", lambda t: (spec, spec.apply(rated), spec.apply(rated)))
    monkeypatch.setattr(factorization, "indexed", lambda t: (None, None, rated))
    for name in ("fit_gbt", "fit_until_flat", "fit_stack", "grid_search", "random_search", "refine_search"):
        monkeypatch.setattr(R, name, record(name))
    monkeypatch.setattr(M, "tune_als", record("tune_als"))
    for plan in ("rating_regressor", "rating_regressor_rmse", "feature_importance", "permutation_importance"):
        with pytest.raises(Seen):
            getattr(learning, plan)(None)
        args, kwargs = seen.pop("fit_gbt")
        assert len(args) == 1 and not kwargs
    for plan, name in (("grid_search", "grid_search"), ("random_search", "random_search"), ("sequential_search", "refine_search")):
        with pytest.raises(Seen):
            getattr(learning, plan)(None)
        args, kwargs = seen[name]
        assert args[0].getMaxIter() == R.gbt().getMaxIter() and kwargs["folds"] == 5
    with pytest.raises(Seen):
        learning.early_stopping(None)
    assert len(seen["fit_until_flat"][0]) == 2 and not seen["fit_until_flat"][1]
    with pytest.raises(Seen):
        learning.stacked_regressor(None)
    assert seen["fit_stack"][1] == {"folds": 5}
    for plan, own in (("als_grid_search", {}), ("als_kfold", {"folds": 5})):
        with pytest.raises(Seen):
            getattr(factorization, plan)(None)
        args, kwargs = seen["tune_als"]
        assert sorted(args[1]) == ["alpha", "rank", "reg"] and all(len(v) > 2 for v in args[1].values()) and kwargs == own


def test_constant_columns_are_dropped_per_cluster(spark, rated):
    small = {"large": {"maxIter": 1, "maxDepth": 1}}
    rows = rated.withColumn("a", F.when(F.col("Cluster") == 1, F.lit(7.0)).otherwise(F.col("a")))
    models = R.fit_by_cluster(rows, NAMES, {0: "large", 1: "large"}, tier_params=small, cluster_params={1: {"maxIter": 2}})
    assert [tuple(r) for r in R.dropped_columns(models, spark).where("column_name = 'a'").collect()] == [(1, "a")]
    assert "a" in models[0][0].names and "a" in models[None][0].names
    assert (models[0][1].getNumTrees, models[1][1].getNumTrees) == (1, 2)
    assert R.predict_clip(models, rows).count() == rows.count()


def test_release_deletes_what_was_written(spark, monkeypatch):
    from affinia import session

    monkeypatch.setattr(session, "scratch_dir", lambda spark, own=session.scratch_dir(spark) + "-release": own)
    session.materialise(spark.range(3))
    folder = session.scratch_dir(spark)
    assert len(os.listdir(folder)) == 1
    session.release(spark)
    assert not os.path.exists(folder)


def test_missing_photos_get_zeros(spark):
    photos = spark.createDataFrame([("p1",), ("p2",)], "photo_id string")
    vectors = spark.createDataFrame([("p1", [1.0, 2.0])], "photo_id string, embedding array<double>")
    assert {r.photo_id: r.embedding for r in X.image_table(photos, vectors, 2).collect()} == {"p1": [1.0, 2.0], "p2": [0.0, 0.0]}


def test_random_search_stops_at_the_goal(rated):
    rows = R.FeatureSpec.fit(rated, NAMES).apply(rated).select("stars", "features")
    _, log = R.random_search(R.gbt({"maxIter": 1}), rows, {"maxDepth": (1, 3)}, n=4, folds=2, goal=10.0, batch=2)
    assert log.count() == 2


def test_first_trees_equal_a_shorter_fit(rated):
    rows = R.FeatureSpec.fit(rated, NAMES).apply(rated).coalesce(1)
    long, short = (R.fit_gbt(rows, {"maxIter": n, "maxDepth": 2}) for n in (6, 3))
    cut = R.first_trees(long, 3)
    assert cut.getNumTrees == 3 and cut.numFeatures == long.numFeatures
    got, want = ([r.prediction for r in m.transform(rows).select("prediction").collect()] for m in (cut, short))
    assert got == pytest.approx(want)


def searched(rated):
    return R.FeatureSpec.fit(rated, NAMES).apply(rated).select("stars", "features")


def test_trials_equal_fits_one_by_one(rated):
    """Concurrent fits over written folds give the errors and the model of a plain loop over the same folds."""
    rows = searched(rated).withColumn("fold", F.floor(F.col("stars") * 7).cast("int") % 3)
    grid = {"maxDepth": [1, 3], "stepSize": [0.1, 0.5]}
    model, log = R.grid_search(R.gbt({"maxIter": 2, "subsamplingRate": 1.0}), rows, grid, folds=3)
    got = {(r.maxDepth, r.stepSize): r.rmse for r in log.collect()}
    assert len(got) == 4
    for depth, step in got:
        errors = []
        for fold in range(3):
            one = R.gbt({"maxIter": 2, "subsamplingRate": 1.0, "maxDepth": int(depth), "stepSize": step})
            fitted = one.fit(rows.where(F.col("fold") != fold))
            errors.append(fitted.transform(rows.where(F.col("fold") == fold)).agg(rmse_of("prediction").alias("e")).first().e)
        assert got[depth, step] == pytest.approx(sum(errors) / 3, rel=1e-6)
    depth, step = min(got, key=got.get)
    assert (model.getOrDefault("maxDepth"), model.getOrDefault("stepSize")) == (depth, step)


@pytest.fixture(scope="module")
def many(spark):
    """More rows than the sample of the split candidates has places for bins, in several partitions."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 3))
    v[:, 2] = rng.integers(0, 5, 4000)
    stars = 3 + v[:, 0] - 0.5 * v[:, 1] + (v[:, 2] == 2) + rng.normal(scale=0.2, size=4000)
    rows = [(float(y), DenseVector(x)) for x, y in zip(v, stars)]
    return spark.createDataFrame(rows, ["stars", "features"]).repartition(5).persist()


def test_boosted_trees_equal_those_of_spark(many, monkeypatch):
    """Models grown side by side over binned rows predict what Spark ML's fits predict, and weigh the columns alike."""
    spark = many.sparkSession
    settings = [{"maxDepth": 3, "maxIter": 5}, {"maxDepth": 5, "maxIter": 4, "stepSize": 0.3, "minInstancesPerNode": 40}, {"maxDepth": 1, "maxIter": 3}]
    estimators = [R.gbt({"subsamplingRate": 1.0} | {k: v for k, v in s.items() if k != "minInstancesPerNode"}) for s in settings]
    estimators[1].setMinInstancesPerNode(40)
    binned = boosting.Binned.write(many, estimators[0])
    for direct in (32, 1):
        monkeypatch.setattr(boosting, "DIRECT", direct)
        models = boosting.fit_many(estimators, binned, spark)
        errors = boosting.squares(models, many)
        for estimator, model, (n, total) in zip(estimators, models, errors):
            own, want = model.to_spark(), estimator.fit(many)
            got = np.array([r.prediction for r in own.transform(many).select("prediction").collect()])
            assert got == pytest.approx(np.array([r.prediction for r in want.transform(many).select("prediction").collect()]), abs=1e-9)
            assert own.treeWeights == want.treeWeights and own.getOrDefault("maxDepth") == estimator.getMaxDepth()
            assert [t.numNodes for t in own.trees] == [t.numNodes for t in want.trees]
            assert own.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-3)
            assert n == 4000 and (total / n) ** 0.5 == pytest.approx(rmse(own.transform(many)), rel=1e-9)


def test_a_fit_of_drawn_rows_is_repeated_and_as_good(many, monkeypatch):
    """Draws follow seed, tree and block, not the tasks; trees not yet written count as those written do."""
    first, second = (R.fit_gbt(many.coalesce(1), {"maxIter": 6}) for _ in range(2))
    monkeypatch.setattr(boosting, "TREES_A_WRITE", 4)
    third = R.fit_gbt(many.coalesce(1), {"maxIter": 6})
    found = [[r.prediction for r in m.transform(many).select("prediction").collect()] for m in (first, second, third)]
    assert found[0] == found[1] and found[2] == pytest.approx(found[0], abs=1e-9)
    assert rmse(first.transform(many)) == pytest.approx(rmse(R.gbt({"maxIter": 6}).fit(many).transform(many)), rel=0.05)
    assert not boosting.fits(R.gbt().setValidationIndicatorCol("v")) and not boosting.fits(trials) and boosting.fits(R.gbt())


def test_settings_of_boosted_trees_share_a_pass(many, monkeypatch):
    """A search makes one pass a level and fold for all settings, and fits only what its log lacks."""
    passes, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a: passes.append(len(a[8])) or level(*a))
    path, grid = scratch_path(many.sparkSession, "search"), {"maxDepth": [2, 3], "stepSize": [0.1, 0.2]}
    _, log = R.grid_search(R.gbt({"maxIter": 2}), many, grid, folds=3, log_path=path)
    # three folds and the last fit, two trees, three levels at most; two models go on to the third
    assert len(passes) <= 24 and passes.count(4) == 3 * 2 * 2 and log.count() == 4
    passes.clear()
    _, again = R.grid_search(R.gbt({"maxIter": 2}), many, grid | {"maxDepth": [2, 3, 1]}, folds=3, log_path=path)
    assert max(passes) == 2 and {r.rmse for r in log.collect()} <= {r.rmse for r in again.collect()} and again.count() == 6


def test_a_search_goes_on_where_it_was_ended(spark, rated):
    path, rows = scratch_path(spark, "search"), searched(rated)
    fitted = []

    class Counted:
        def __init__(self, inner, limit):
            self.inner, self.limit = inner, limit

        def getParam(self, name):
            return self.inner.getParam(name)

        def fit(self, part, params):
            if len(fitted) >= self.limit:
                raise RuntimeError("driver lost")
            fitted.append({p.name: v for p, v in params.items()})
            return self.inner.fit(part, params)

    grid = {"maxDepth": [1, 2, 3]}
    with pytest.raises(RuntimeError):
        R.grid_search(Counted(R.gbt({"maxIter": 1}), 4), rows, grid, folds=2, log_path=path)
    assert len(fitted) == 4
    _, log = R.grid_search(Counted(R.gbt({"maxIter": 1}), 100), rows, grid, folds=2, log_path=path)
    assert len(fitted) == 7  # two fits that were missing, and the best setting on all rows
    _, fresh = R.grid_search(R.gbt({"maxIter": 1}), rows, grid, folds=2)
    assert len(log.collect()) == 3 and all(r.rmse > 0 for r in log.collect()) and fresh.count() == 3


def test_folds_are_packed_by_their_bytes(rated, monkeypatch):
    rows = searched(rated).repartition(6)
    small = trials.Folds.write(rows, 3, 42)
    assert small.partitions == 1 and small.concurrent == 2 * rated.sparkSession.sparkContext.defaultParallelism
    train, test = small.parts(1)
    assert train.rdd.getNumPartitions() == 1 and train.count() + test.count() == rows.count() == small.all().count()
    monkeypatch.setattr(trials, "PACK_BYTES", 2000)
    large = trials.Folds.write(rows, 3, 42)
    assert large.partitions > 4 and large.concurrent < small.concurrent
    assert trials.best_of([{}, {}, {}], [None, 2.0, 2.0]) == 1 and trials.best_of([{}], [None]) == 0


def test_the_last_fit_takes_all_cores(rated, tips, monkeypatch):
    monkeypatch.setattr(trials, "LONE_BYTES", 500)
    cores, spark = rated.sparkSession.sparkContext.defaultParallelism, rated.sparkSession
    cut = trials.Folds.write(searched(rated), 2, 42)
    assert cut.all().rdd.getNumPartitions() == 1 and cut.all_spread().rdd.getNumPartitions() == cores
    assert cut.all_spread().columns == ["stars", "features"] and cut.all_spread().count() == 600
    seen = []

    class Kept:
        def fit(self, rows, params):
            seen.append(rows.rdd.getNumPartitions())
            return R.gbt({"maxIter": 1}).fit(rows)

        def getParam(self, name):
            return name

    R.grid_search(Kept(), searched(rated), {"maxDepth": [1, 2]}, folds=2)
    assert seen == [1] * 4 + [cores]
    blocks, als = [], M.als
    monkeypatch.setattr(M, "als", lambda **s: blocks.append(s["blocks"]) or als(**s | {"max_iter": 1}))
    monkeypatch.setattr(M, "RATINGS_WORTH_A_BLOCK", 30)
    users, businesses = index_ids(tips, "user_id"), index_ids(tips, "business_id")
    ratings = implicit_ratings(interaction_counts(tips), users, businesses)
    _, log = M.tune_als(ratings, {"rank": [2, 3]}, reg=0.1, alpha=1.0)
    assert log.count() == 2 and blocks[:2] == [1, 1] and blocks[2] == min(cores, -(-ratings.count() // 30)) > 1


def test_base_fits_of_a_stack_run_side_by_side(rated, monkeypatch):
    seen, run_all = [], R.run_all
    monkeypatch.setattr(R, "run_all", lambda spark, jobs, at_once: seen.append((sorted(jobs), at_once)) or run_all(spark, jobs, at_once))
    monkeypatch.setattr(R, "gbt", lambda seed, gbt=R.gbt: gbt({"maxIter": 3}, seed))
    scored = R.fit_stack(rated, NAMES, folds=2)(rated)
    assert seen[0][0] == sorted(f"{n}-{f}" for n in ("gbt", "forest", "linear") for f in (0, 1, None)) and seen[0][1] > 1
    spread = rated.agg(F.stddev_pop("stars")).scalar()
    found = scored.agg(F.count("*").alias("n"), rmse_of("prediction").alias("rmse"), spread.alias("spread")).first()
    assert found.n == 600 and found.rmse < 0.8 * found.spread


def test_blocks_follow_the_ratings():
    assert [M.block_count(n, 8) for n in (0, 50_000, 250_000, 10_000_000)] == [1, 1, 3, 8]
    assert M.block_count(10**10, 1000) == 2000 and M.block_count(10**9, 4000) == 4000


def test_model_round_trip(spark, rated):
    from affinia.plans.learning import linear_model

    spec = R.FeatureSpec.fit(rated, NAMES)
    model, path = linear_model(spec.apply(rated)), scratch_path(spark, "model")
    files.save_model(model, path)
    assert files.load_model(path, LinearRegressionModel).coefficients == model.coefficients


def test_clusters_are_stable_and_nearest(spark):
    rows = [(f"u{i}", city, n) for i in range(30) for city, n in ((f"c{i % 3}", 5 + i % 2), ("shared", 1))]
    visits = spark.createDataFrame(rows, "user_id string, city string, visits long")
    first = {r.user_id: r.Cluster for r in C.user_clusters(visits, k=3).collect()}
    again = {r.user_id: r.Cluster for r in C.user_clusters(visits.repartition(7), k=3).collect()}
    assert first == again and set(first.values()) == {0, 1, 2}
    assert len({(u % 3, first[f"u{u}"]) for u in range(30)}) == 3


def test_silhouettes_of_all_k_equal_those_one_by_one(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator

    rng = np.random.default_rng(3)
    rows = [(f"u{i:03d}", f"c{(i % 4) * 2 + int(j)}", int(rng.integers(1, 9))) for i in range(80) for j in range(2)] + [("alone", "far", 900)]
    vectors = C.city_vectors(spark.createDataFrame(rows, "user_id string, city string, visits long"))
    ks = [2, 3, 5]
    assigned, want = vectors, {}
    for k in ks:
        model = C._fit(vectors.select("user_id", "features"), k, 42, 50)
        assigned = model.transform(assigned)
        judge = ClusteringEvaluator(featuresCol="features", predictionCol=f"raw_{k}")
        want[k] = judge.evaluate(model.transform(vectors.select("user_id", "features")))
    got = C.silhouette(assigned.select("at", "x", F.array(*[f"raw_{k}" for k in ks]).alias("raw")), ks)
    assert got == pytest.approx(want, abs=1e-9)
    scanned = C.scan_k(spark.createDataFrame(rows, "user_id string, city string, visits long"), ks).collect()
    assert [r.k for r in scanned] == ks and all(r.cost >= 0 for r in scanned)


def test_principal_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ np.array([[5.0, 1, 0], [0, 2, 1], [0, 0, 0.5]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(99, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r.id: r.components for r in X.pca(df, "id", ["a", "b", "c"], 2).collect()}
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:2]
    axes = np.array([v if v[np.abs(v).argmax()] > 0 else -v for v in axes])
    assert got.pop(99) is None
    assert np.allclose([got[i] for i in range(60)], centred @ axes.T)
    assert X.pca(df.limit(0), "id", ["a", "b", "c"]).count() == 0


def test_hash_split_keeps_small_and_odd_fractions(spark):
    df = spark.range(100_000)
    for fractions in ({"a": 0.004, "b": 0.996}, {"a": 0.125, "b": 0.125, "c": 0.75}):
        counts = {r.split: r["count"] for r in X.hash_split(df, ["id"], fractions).groupBy("split").count().collect()}
        assert set(counts) == set(fractions)
        for name, share in fractions.items():
            assert abs(counts[name] - 100_000 * share) < 4 * (100_000 * share * (1 - share)) ** 0.5
    with pytest.raises(ValueError):
        X.hash_split(df, ["id"], {"a": 0.5, "b": 0.4})


def test_stratified_split_keeps_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("label"))
    counts = {(r.label, r.split): r["count"] for r in X.stratified_split(df, "label", "id").groupBy("label", "split").count().collect()}
    assert counts == {("rare", "train"): 80, ("rare", "test"): 20, ("hot", "train"): 720, ("hot", "test"): 180}


def test_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1, "x", None, 1), (2, "x", None, 2)], "id int, same string, empty int, vary int")
    kept, names = Q.drop_constant(df, keep=("id",))
    assert names == ["same"] and kept.columns == ["id", "empty", "vary"]


def test_pooling_skips_zero_vectors(spark):
    df = spark.createDataFrame([("b1", [1.0, 3.0]), ("b1", [0.0, 0.0]), ("b1", [3.0, -1.0]), ("b2", [0.0, 0.0])], "business_id string, v array<double>")
    ids = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "business_id string")
    mean = {r.business_id: r.features for r in A.pool(df, "business_id", "v", 2, "mean", ids).collect()}
    assert mean == {"b1": [2.0, 1.0], "b2": [0.0, 0.0], "b3": [0.0, 0.0]}
    assert {r.business_id: r.features for r in A.pool(df, "business_id", "v", 2, "max", ids).collect()}["b1"] == [3.0, 3.0]


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "Good food, good FOOD"), (2, "   "), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in X.embed_text(df, "id", "text", 16).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and got[2] == got[3] == [0.0] * 16
    import pandas as pd

    encoded = X.embed_text(df, "id", "text", 2, encoder=lambda s: pd.Series([[float(len(t or "")), 1.0] for t in s]))
    assert {r.id: r.embedding for r in encoded.collect()} == {1: [20.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_histogram_lists_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,), (None,)], "x double")
    assert [r.n for r in histogram(df, "x", 10).orderBy("bin").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.n for r in histogram(flat, "x", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_jsonl_and_csv(spark):
    path = scratch_path(spark, "lines")
    lines = spark.createDataFrame([('{"user_id":"u1","business_id":"b1","x":1}',), ('{"user_id": "u2',), ("",)], "value string")
    lines.coalesce(1).write.text(path)
    assert [tuple(r) for r in files.read_jsonl(spark, path, schemas.TIPS).collect()] == [("u1", "b1")]
    assert [r.line for r in files.malformed_lines(spark, path, schemas.TIPS).collect()] == ['{"user_id": "u2']
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("user_id, business_id",), (" u1 ,b1 ",)], "value string").coalesce(1).write.text(path)
    assert [tuple(r) for r in files.read_csv(spark, path, schemas.PAIRS).collect()] == [("u1", "b1", None)]


def test_zero_vector_count(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int").withColumn("features", F.when(F.col("id") == 1, zeros(3)))
    assert tuple(Q.default_vector_counts(df).first()) == (2, 1, 1)
