"""Derived user, business and review records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.functions.scalars import (
    REFERENCE_YEAR, REVIEW_AS_OF, account_age, csv_len, interaction_total, sum_prefix, years_online,
)


def transform_users(df: DataFrame, ref_year: int = REFERENCE_YEAR) -> DataFrame:
    """User features; `compliment_funny` only enters the compliment total."""
    single = [c for c in df.columns if c.startswith("compliment_") and c != "compliment_funny"]
    return df.select(
        "user_id", "average_stars", F.col("review_count").alias("user_review_count"),
        "fans", "useful", "funny", "cool",
        interaction_total("useful", "funny", "cool").alias("num_interactions"),
        account_age("yelping_since", ref_year).alias("yelping_since"),
        csv_len("friends").alias("friends_count"),
        csv_len("elite").alias("elite_years"),
        sum_prefix(df, "compliment_").alias("compliments"),
        *single,
    )


def transform_businesses(df: DataFrame) -> DataFrame:
    return df.select(
        "business_id", F.col("stars").alias("bus_stars"), F.col("review_count").alias("bus_review_count"),
        "categories", "city", "is_open",
    )


def transform_reviews(df: DataFrame, as_of: str = REVIEW_AS_OF) -> DataFrame:
    """Reviews with their feedback count and its yearly rate.

    A date that cannot be read keeps the row and leaves the rate null.
    """
    total = interaction_total("cool", "funny", "useful")
    return df.select(
        "review_id", "user_id", "business_id", "stars", "useful",
        total.alias("ufc_count"),
        (total / years_online("date", as_of)).alias("ufc_count_per_year"),
    )
