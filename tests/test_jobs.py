"""The batch jobs from files to files."""

import math
import os

import pytest
from pyspark.sql import functions as F

from affinia import jobs
from affinia.functions.scalars import hash32
from affinia.session import scratch_path
from affinia.sources import files, schemas
from affinia.sources.adapters import Tables


@pytest.fixture(scope="module")
def folder(spark):
    t = Tables(spark, "/root/testdata/sf0.001").shared()
    path = scratch_path(spark, "job")
    extra = [F.lit(1).alias(f"compliment_{c}") for c in schemas.COMPLIMENTS if c not in ("hot", "more", "funny")]
    t.users.select("*", *extra).write.json(os.path.join(path, "user.json"))
    t.businesses.write.json(os.path.join(path, "business.json"))
    t.reviews.drop("flag").write.json(os.path.join(path, "review_train.json"))
    t.tips.write.json(os.path.join(path, "tip.json"))
    held = hash32("user_id", "business_id") % 5 == 0
    late = hash32(F.lit("late"), "user_id", "business_id") % 4 == 0
    files.write_csv(t.pairs.where(~held & ~late), os.path.join(path, "train.csv"))
    files.write_csv(t.pairs.where(~held & late), os.path.join(path, "validation.csv"))
    files.write_csv(t.pairs.where(held), os.path.join(path, "test.csv"))
    return path


def test_rating_job(spark, folder):
    test, out = os.path.join(folder, "test.csv"), os.path.join(folder, "out.csv")
    light = {tier: {"maxIter": 3, "maxDepth": 3} for tier in ("large", "moderate", "small")}
    train = ",".join(os.path.join(folder, name) for name in ("train.csv", "validation.csv"))
    predicted = jobs.rating_job(
        spark, folder, train, test, out,
        als_settings={"rank": 4, "reg": 0.5, "alpha": 40.0, "max_iter": 3, "blocks": 2}, clusters=3, tier_params=light,
    )
    truth = files.read_csv(spark, test, schemas.PAIRS)
    assert predicted.count() == truth.count() and predicted.where("prediction not between 1 and 5").count() == 0
    score = jobs.rmse_job(spark, test, out).first()
    assert score.n == truth.count() and score.rmse < truth.agg(F.stddev_pop("stars")).first()[0]


def test_tuning_job(spark, folder):
    grid = {"rank": [2, 3], "reg": [0.5], "alpha": [1.0, 40.0]}
    log = jobs.tuning_job(spark, os.path.join(folder, "tip.json"), os.path.join(folder, "log.csv"), grid, max_iter=2, blocks=2).collect()
    assert sorted((r["rank"], r["alpha"]) for r in log) == [(2, 1), (2, 40), (3, 1), (3, 40)]
    assert all(r.rmse > 0 for r in log) and [r.rmse for r in log] == sorted(r.rmse for r in log)


def test_ranking_job(spark, folder):
    t = Tables(spark, "/root/testdata/sf0.001")
    data = os.path.join(folder, "ranking")
    t.businesses.write.json(os.path.join(data, "business.json"))
    named = t.texts.select("business_id", "text", F.lit("u1").alias("user_id"))
    named.write.json(os.path.join(data, "review_train.json"))
    t.photos.select("photo_id", "business_id", "label").write.json(os.path.join(data, "photo.json"))
    files.write_table(t.photos.select("photo_id", "embedding"), os.path.join(data, "photo_vectors.parquet"))
    out, test = os.path.join(folder, "ranked.csv"), files.read_csv(spark, os.path.join(folder, "test.csv"), schemas.PAIRS)
    found = jobs.ranking_job(spark, data, os.path.join(folder, "train.csv"), os.path.join(folder, "test.csv"), out, k=5).collect()
    lists = {}
    for r in found:
        lists.setdefault(r.user_id, []).append((r.rank, r.business_id, r.score))
    pairs = {(r.user_id, r.business_id) for r in test.collect()}
    assert set(lists) <= {u for u, _ in pairs}
    for ranked in lists.values():
        ranked.sort()
        assert [k for k, _, _ in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) == 5
        assert len({b for _, b, _ in ranked}) == 5 and all(x[2] >= y[2] for x, y in zip(ranked, ranked[1:]))
    # the metrics follow from the files
    place = {(u, b): k for u, ranked in lists.items() for k, b, _ in ranked}
    hits = [place.get(pair) for pair in pairs]
    read = lambda name: {r[0]: float(r[1]) for r in spark.read.csv(f"{out}-{name}", header=True).collect()}
    metrics = read("metrics")
    assert metrics["recall"] == pytest.approx(sum(h is not None for h in hits) / len(hits))
    assert metrics["map"] == pytest.approx(sum(1 / h for h in hits if h) / len(hits))
    assert metrics["ndcg"] == pytest.approx(sum(1 / math.log2(h + 1) for h in hits if h) / len(hits))
    weights = read("weights")
    assert list(sorted(weights)) == ["categories", "numbers", "photo", "text"] and min(weights.values()) >= 0 < max(weights.values())
    layout = {r[0]: (int(r[1]), int(r[2])) for r in spark.read.csv(f"{out}-layout", header=True).collect()}
    assert layout["numbers"] == (0, 4) and layout["text"][0] == 4 + layout["categories"][1] and layout["photo"][1] == jobs.PHOTO_DIM


def test_ranking_job_without_photos_and_texts(spark, folder):
    data = os.path.join(folder, "bare")
    Tables(spark, "/root/testdata/sf0.001").businesses.write.json(os.path.join(data, "business.json"))
    spark.createDataFrame([("r1", "b1")], "review_id string, business_id string").write.json(os.path.join(data, "review_train.json"))
    out = os.path.join(folder, "bare.csv")
    found = jobs.ranking_job(spark, data, os.path.join(folder, "train.csv"), os.path.join(folder, "test.csv"), out, k=3)
    assert found.count() > 0 and found.where("rank > 3").count() == 0


def test_similarity_job(spark, folder):
    out = os.path.join(folder, "similar.csv")
    found = jobs.similarity_job(spark, os.path.join(folder, "train.csv"), out, 0.2)
    rows = [(r.business_id_1, r.business_id_2) for r in found.collect()]
    assert rows and all(a < b for a, b in rows) and found.where("similarity < 0.2").count() == 0
