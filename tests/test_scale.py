"""Ordered work in slices against a plain sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia.operators import scale
from affinia.operators.scale import bucketed_row_number, dense_index, exact_quantiles


def test_dense_index_is_the_sorted_order(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(3000))).alias("k"))
    got = {r.k: r.idx for r in dense_index(df, "k").collect()}
    want = {k: i for i, k in enumerate(sorted({r.k for r in df.collect()}))}
    assert got == want


def test_dense_index_of_nothing_and_one(spark):
    assert dense_index(spark.createDataFrame([(None,)], "k string"), "k").count() == 0
    assert [tuple(r) for r in dense_index(spark.createDataFrame([("a",)], "k string"), "k").collect()] == [("a", 0)]


def test_bucketed_row_number(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("x"), "id")
    ranked = bucketed_row_number(df.withColumn("b", F.floor(F.col("x") / 5000)), ["g"], "b", ["x", "id"], "rn")
    by_group = {}
    for r in ranked.collect():
        by_group.setdefault(r.g, []).append((r.x, r.id, r.rn))
    for rows in by_group.values():
        assert [rn for _, _, rn in sorted(rows)] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_quantiles(spark, keys):
    """Small groups, one hot group with heavy ties, and outliers."""
    rng = np.random.default_rng(1)
    rows = [("small", float(x)) for x in rng.normal(size=7)] + [("one", 2.5)]
    rows += [("hot", float(x)) for x in np.round(rng.lognormal(0, 3, 25_000), 3)] + [("hot", 1.0)] * 12_000
    rows += [("small", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"] if keys else None, r.p): r.quantile for r in exact_quantiles(df, keys, "v", probs).collect()}
    groups = {g: [v for k, v in rows if k == g and v is not None] for g in ("small", "one", "hot")} if keys else {
        None: [v for _, v in rows if v is not None]
    }
    for g, vs in groups.items():
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(vs, p)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_of_narrow_brackets(spark, tiny_buckets, keys):
    """Brackets that are cut until they hold a few rows: ties, outliers, values that differ in their last bit, infinities."""
    rng = np.random.default_rng(2)
    groups = {
        "ties": [1.0] * 4000 + [2.0] * 4000 + [1.5], "two": [0.0] * 50 + [1e300] * 50, "negative": (-rng.lognormal(0, 40, 3000)).tolist(),
        "close": (1.0 + rng.integers(0, 50, 2000) * 2.0**-52).tolist(), "infinite": [float("-inf"), *rng.normal(size=500).tolist(), float("inf")],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan"))], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"] if keys else None, r.p): r.quantile for r in exact_quantiles(df, keys, "v", probs).collect()}
    for g, vs in (groups if keys else {None: [v for vs in groups.values() for v in vs]}).items():
        for p in probs:
            vs = sorted(vs)
            rank = (len(vs) - 1) * p
            a, b = vs[int(np.floor(rank))], vs[int(np.ceil(rank))]
            assert got[(g, p)] == pytest.approx(a if a == b else a + (b - a) * (rank - np.floor(rank)), rel=1e-12)


def test_quantiles_of_a_million_values_close_together(spark, monkeypatch):
    """All values between two outliers: one cell holds them after the first round."""
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 1000)
    inner = spark.range(1_000_000).select((F.lit(5.0) + F.pmod(F.col("id") * 7919, F.lit(1_000_000)) * 1e-9).alias("v"))
    df = inner.unionByName(spark.createDataFrame([(-1e12,), (1e15,)], "v double"))
    got = {r.p: r.quantile for r in exact_quantiles(df, [], "v", [0.25, 0.5, 0.999]).collect()}
    vs = np.sort(np.concatenate([[-1e12], 5.0 + np.arange(1_000_000) * 1e-9, [1e15]]))
    assert got == pytest.approx({p: float(np.quantile(vs, p)) for p in (0.25, 0.5, 0.999)}, rel=1e-13)
