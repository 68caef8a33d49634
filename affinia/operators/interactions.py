"""Interaction counts, integer ids, pair routing and per-user rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinia.functions.scalars import MAX_INTERACTIONS, half_precision, log_affinity
from affinia.operators.scale import dense_index

PAIR = ["user_id", "business_id"]


def interaction_counts(tips: DataFrame) -> DataFrame:
    """Tips per (user, business)."""
    return tips.groupBy(*PAIR).agg(F.count("*").alias("n"))


def interaction_lists(counts: DataFrame) -> DataFrame:
    """Every user's (business, n) list, one row per entry with the list length.

    A list column would put a hot user's whole history into one row.
    """
    sizes = counts.groupBy("user_id").agg(F.count("*").alias("list_size"))
    return counts.join(sizes, "user_id")


def index_ids(df: DataFrame, col: str) -> DataFrame:
    """(id, idx) with a dense integer per distinct id."""
    return dense_index(df, col, "idx")


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Add the lexicographic code of a column; null stays null."""
    out = out or f"{col}_encoded"
    return df.join(dense_index(df, col, out), col, "left")


def decode_ids(df: DataFrame, index: DataFrame, idx_col: str, id_col: str, unknown: str = "Unknown") -> DataFrame:
    """Replace an index by its id; an index that is not listed decodes to `unknown`."""
    names = index.select(F.col("idx").alias(idx_col), F.col(id_col))
    return df.join(names, idx_col, "left").withColumn(id_col, F.coalesce(id_col, F.lit(unknown))).drop(idx_col)


def implicit_ratings(
    counts: DataFrame, users: DataFrame, businesses: DataFrame, max_n: int = MAX_INTERACTIONS, raw: bool = False
) -> DataFrame:
    """(user idx, business idx, rating) with half-precision log ratings, or the raw counts."""
    rating = F.col("n") if raw else half_precision(log_affinity("n", max_n))
    return (
        counts.join(users.withColumnRenamed("idx", "user"), "user_id")
        .join(businesses.withColumnRenamed("idx", "business"), "business_id")
        .select(
            F.col("user").cast("int").alias("user"),
            F.col("business").cast("int").alias("business"),
            rating.cast("float").alias("rating"),
        )
    )


def route_pairs(pairs: DataFrame, users: DataFrame, businesses: DataFrame) -> DataFrame:
    """Flag which ids of a pair are known; only pairs with both are 'valid'."""
    u = users.select("user_id").distinct().withColumn("user_known", F.lit(True))
    b = businesses.select("business_id").distinct().withColumn("business_known", F.lit(True))
    known = F.coalesce("user_known", F.lit(False)) & F.coalesce("business_known", F.lit(False))
    return (
        pairs.join(u, "user_id", "left")
        .join(b, "business_id", "left")
        .withColumn("route", F.when(known, "valid").otherwise("missing"))
        .withColumn("user_known", F.coalesce("user_known", F.lit(False)))
        .withColumn("business_known", F.coalesce("business_known", F.lit(False)))
    )


def top_k_per(df: DataFrame, keys: list[str], order: list[Column | str], k: int, out: str = "rank") -> DataFrame:
    """Best k rows per key. The filter on the rank lets Spark cut each group to k
    rows before the shuffle, so a hot key moves k rows per task."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


def top_k(df: DataFrame, by: str, k: int, *ties: str, desc: bool = True) -> DataFrame:
    """First k rows of the whole frame by one column, ties by the given keys."""
    first = F.desc(by) if desc else F.asc(by)
    return df.orderBy(first, *ties).limit(k)


def user_top_k(counts: DataFrame, k: int = 3, max_n: int = MAX_INTERACTIONS) -> DataFrame:
    """Top businesses per user by interaction count, with their log affinity."""
    ranked = top_k_per(counts, ["user_id"], [F.desc("n"), "business_id"], k)
    return ranked.withColumn("affinity", log_affinity("n", max_n))


def interaction_stats(counts: DataFrame) -> DataFrame:
    """Distinct ids and the distribution of counts, in one row."""
    return counts.agg(
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("business_id").alias("n_businesses"),
        F.count("*").alias("n_pairs"),
        F.avg("n").alias("mean_n"),
        F.stddev_pop("n").alias("stdev_n"),
        F.max("n").alias("max_n"),
        F.min("n").alias("min_n"),
    )


def bin_number(col: Column | str, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value, the last bin closed on the right."""
    c = F.col(col) if isinstance(col, str) else col
    width = (high - low) / F.lit(float(bins))
    return F.when(width > 0, F.least(F.floor((c - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(
        F.lit(0).cast("bigint")
    )


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] with empty bins listed."""
    values = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    ends = values.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()
    counted = (
        values.withColumn("ends", ends)
        .groupBy(bin_number("x", F.col("ends.low"), F.col("ends.high"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return (
        grid.join(counted, "bin", "left")
        .withColumn("ends", ends)
        .select(
            "bin",
            (F.col("ends.low") + F.col("bin") * (F.col("ends.high") - F.col("ends.low")) / F.lit(float(bins))).alias("low"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def histogram2d(df: DataFrame, x: str, y: str, x_bins: int, y_bins: int) -> DataFrame:
    """Counts per cell of an equal-width grid; empty cells are left out."""
    values = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    ends = values.agg(
        F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    ).scalar()
    return (
        values.withColumn("e", ends)
        .groupBy(
            bin_number("x", F.col("e.x0"), F.col("e.x1"), x_bins).alias("x_bin"),
            bin_number("y", F.col("e.y0"), F.col("e.y1"), y_bins).alias("y_bin"),
        )
        .agg(F.count("*").alias("n"))
    )
