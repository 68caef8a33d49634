"""Queries on large tables: the big tables are joined once, and what a task holds does not grow."""

import pytest
from pyspark.sql import functions as F

from affinia.operators import aggregates as A
from affinia.operators import blocks as B
from affinia.operators import models as R
from affinia.plans import QUERIES
from affinia.session import tune

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pair_routing", "category_sets", "top_business_categories"])
def test_the_pairs_are_read_as_written(spark, name):
    assert "l_orderkey" not in plan_of(QUERIES[name](spark, SF_DIR))


def test_category_sets_without_the_map(spark):
    businesses = spark.createDataFrame(
        [("b1", "a, b"), ("b2", "b, c, b"), ("b3", None), ("b4", "alone"), ("b5", ", a"), ("b6", "")], "business_id string, categories string"
    )
    visits = [("u1", "b1"), ("u1", "b1"), ("u1", "b2"), ("u2", "b2"), (None, "b1"), ("u3", "b3"), ("u4", "b9"), ("u4", "b5"), ("u5", "b6")]
    pairs = spark.createDataFrame(visits, "user_id string, business_id string")
    want = A.category_sets(A.category_user_map(businesses, pairs))
    got = A.visited_category_sets(businesses, pairs)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert "Expand" not in plan_of(got)


def test_a_fit_gets_partitions_by_rows(spark, monkeypatch):
    seen = []

    class Tree:
        def fit(self, rows):
            seen.append(rows.rdd.glom().map(len).collect())
            assert rows.columns == ["features", "stars"]

    monkeypatch.setattr(R, "gbt", lambda params, seed: Tree())
    rows = spark.range(1000).selectExpr("array(double(id)) AS features", "double(id % 5) AS stars", "id AS user_id").coalesce(1)
    R.fit_gbt(rows)
    monkeypatch.setattr(R, "FIT_ROWS", 50)
    R.fit_gbt(rows)
    assert seen[0] == [1000] and len(seen[1]) == 20 and sum(seen[1]) == 1000 and max(seen[1]) <= 100


def test_partitions_after_a_shuffle_stay_small(spark):
    """random_split_builtin sorts whole partitions: these are bounded by bytes, not by the number of cores alone."""
    tune(spark)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        rows = spark.range(10_000_000).selectExpr("rand(1) AS a", "rand(2) AS b", "rand(3) AS c").repartition("a")
        sizes = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("a"), F.max("b"), F.max("c")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert max(r["n"] for r in sizes) < 800_000 and sum(r["n"] for r in sizes) == 10_000_000


def test_the_layout_asks_for_categories_alone(spark):
    places = spark.createDataFrame([("b1", "x, y"), ("b2", "y, z"), ("b3", None)], "business_id string, categories string")

    def unread():
        raise AssertionError("read for the layout")

    found = B.business_blocks(places, unread, unread, unread, 8)
    want = [("numbers", 0, 4), ("categories", 4, 3), ("text", 7, 8), ("photo", 15, 8)]
    assert found.layout == want and [tuple(r) for r in found.layout_table().collect()] == want
