"""Checks on keys, counts, ids and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.functions.vectors import is_zero
from affinia.operators.interactions import route_pairs


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step, and whether they agree."""
    n_after = after.agg(F.count("*")).scalar()
    return before.agg(F.count("*").alias("n_before")).withColumn("n_after", n_after).withColumn(
        "preserved", F.col("n_before") == F.col("n_after")
    )


def uniqueness(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows against distinct keys of one table."""
    return df.groupBy(*key).agg(F.count("*").alias("c")).agg(
        F.lit(name).alias("table_name"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_keys"),
    )


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """All rows whose key occurs more than once.

    Keys are counted map-side and joined back; a window over the key would put
    all copies of a hot key into one task.
    """
    repeated = df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    return df.join(repeated, key)


def unknown_rows(decoded: DataFrame, cols: list[str], unknown: str = "Unknown") -> DataFrame:
    """How many rows decoded to the unknown marker, per column."""
    wide = decoded.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c) == unknown).alias(c) for c in cols])
    found = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_unknown")) for c in cols])
    return wide.select("n_rows", F.explode(found).alias("x")).select("x.column_name", "x.n_unknown", "n_rows")


def default_vector_counts(vectors: DataFrame, vec: str = "features") -> DataFrame:
    """Vectors, all-zero vectors and null vectors."""
    return vectors.agg(
        F.count("*").alias("n_vectors"),
        F.count_if(is_zero(vec)).alias("n_zero"),
        F.count_if(F.col(vec).isNull()).alias("n_null"),
    )


def coverage(scores: DataFrame, total) -> DataFrame:
    """Users whose number of scores differs from the number of businesses."""
    counts = scores.groupBy("user_id").agg(F.count("*").alias("n_scores")).withColumn("n_expected", total)
    return counts.where(F.col("n_scores") != F.col("n_expected"))


def cold_start(pairs: DataFrame, users: DataFrame, businesses: DataFrame) -> DataFrame:
    """Pairs by which of their ids are known, with the share of all pairs."""
    total = pairs.agg(F.count("*")).scalar()
    return (
        route_pairs(pairs, users, businesses)
        .groupBy("user_known", "business_known")
        .agg(F.count("*").alias("n"))
        .withColumn("share", F.col("n") / total)
    )


def is_constant(col: str) -> Column:
    """Whether a column has exactly one distinct value, as an aggregate; an all-null column has none.

    The smallest and the largest value tell, so no values are shuffled.
    """
    return F.coalesce(F.min(col) == F.max(col), F.lit(False))


def constant_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, is_constant) of each column, in one pass."""
    cols = [c for c in df.columns if c not in keep]
    wide = df.agg(*[is_constant(c).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("is_constant")) for c in cols])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def drop_constant(df: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Frame without its constant columns, and their names."""
    names = [row["column_name"] for row in constant_columns(df, keep).where("is_constant").collect()]  # a row per column
    return df.drop(*names), names
