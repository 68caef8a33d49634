"""Edge rows of the record formats."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia.functions import scalars as S
from affinia.functions import vectors as V
from affinia.operators.profiles import transform_reviews, transform_users


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_list_length(spark):
    rows = [("None",), ("",), ("a",), ("a, b",)]
    assert values(spark, rows, "c string", S.csv_len("c")) == [0, 1, 1, 2]


def test_account_age(spark):
    rows = [(None,), ("2014-02-03",)]
    assert values(spark, rows, "c string", S.account_age("c")) == [0, 10]


def test_clean_categories(spark):
    rows = [(None,), ("Arts & Entertainment",), ("Foo  Bar",), ("A/B, (C)",)]
    assert values(spark, rows, "c string", S.clean_categories("c")) == [
        [], ["arts entertainment"], ["foobar"], ["a b", "c"],
    ]


def test_split_categories(spark):
    assert values(spark, [("a, b, a, ",), (None,)], "c string", S.split_categories("c")) == [["a", "b"], []]


def test_review_rate(spark):
    rows = [("r1", "2023-12-01"), ("r2", "2014-01-01"), ("r3", None), ("r4", "01/02/2014")]
    df = spark.createDataFrame(rows, "review_id string, date string").select(
        "*", *[F.lit(x).alias(c) for c, x in (("user_id", "u"), ("business_id", "b"), ("stars", 4.0))],
        F.lit(5).alias("useful"), F.lit(3).alias("funny"), F.lit(2).alias("cool"),
    )
    out = {r.review_id: r for r in transform_reviews(df).collect()}
    assert out["r1"].ufc_count == 10 and out["r1"].ufc_count_per_year == 10.0
    assert out["r2"].ufc_count_per_year == pytest.approx(10 / (3652 / 365))
    assert out["r3"].ufc_count_per_year == 10.0
    assert out["r4"].ufc_count_per_year is None and out["r4"].ufc_count == 10


def test_user_profile_drops_only_the_funny_compliment(spark):
    df = spark.createDataFrame(
        [("u", 4.0, 3, 1, 1, None, 2, "2004-01-01", "None", "2016", 1, 2, 4)],
        "user_id string, average_stars double, review_count int, fans int, useful int, funny int, cool int, "
        "yelping_since string, friends string, elite string, compliment_hot int, compliment_funny int, compliment_cute int",
    )
    row = transform_users(df).first()
    assert (row.num_interactions, row.compliments, row.yelping_since, row.friends_count) == (3, 7, 20, 0)
    assert "compliment_funny" not in row and row.compliment_cute == 4


def test_log_scale_round_trip(spark):
    df = spark.range(1, 285).select("id", S.log_affinity("id").alias("s"))
    rows = df.select("id", "s", S.inverse_log_affinity("s").alias("n")).collect()
    assert rows[0].s == 1.0 and rows[-1].s == pytest.approx(5.0)
    assert all(math.isclose(r.n, r.id, rel_tol=1e-9) for r in rows)


def test_half_precision_is_numpy_float16(spark):
    rows = spark.range(1, 285).select(S.log_affinity("id").alias("s"), S.half_precision(S.log_affinity("id")).alias("h")).collect()
    assert all(float(np.float16(r.s)) == r.h for r in rows)


def test_affinity_of_cold_and_absent_pairs(spark):
    assert values(spark, [(1.0,), (None,)], "s double", S.magnified_affinity("s")) == [pytest.approx(50.0), 0.0]


def test_clip_round_bucket(spark):
    rows = [(0.4,), (5.3,), (2.5,), (3.5,), (5.5,), (-0.1,)]
    assert values(spark, rows, "p double", S.clip("p")) == [1.0, 5.0, 2.5, 3.5, 5.0, 1.0]
    assert values(spark, rows, "p double", S.clip("p", low=None)) == [0.4, 5.0, 2.5, 3.5, 5.0, -0.1]
    assert values(spark, rows[2:4], "p double", S.round_stars("p")) == [2.0, 4.0]
    assert values(spark, rows[2:4], "p double", S.round_stars("p", "half_up")) == [3.0, 4.0]
    assert values(spark, rows, "p double", S.star_bucket("p")) == ["1-Star", "5-Star", "3-Star", "4-Star", None, None]


def test_suffix_round_trip(spark):
    tagged = S.with_suffix("c", "_bid")
    assert values(spark, [("b_1",), ("x_bid",)], "c string", S.without_suffix(tagged, "_bid")) == ["b_1", "x_bid"]
    assert values(spark, [("b_bidx",)], "c string", S.without_suffix("c", "_bid")) == ["b_bidx"]


def test_haversine(spark):
    row = spark.range(1).select(S.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))).first()[0]
    assert row == pytest.approx(math.pi * 6371000)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    unit = [r[0] for r in df.select(V.l2_normalize("v")).collect()]
    assert unit == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in df.select(V.is_zero("v")).collect()] == [False, True]
