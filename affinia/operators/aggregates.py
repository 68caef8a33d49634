"""Feedback rates, category relations, pooling and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.functions.scalars import clean_categories, with_suffix
from affinia.functions.vectors import is_zero, zeros
from affinia.operators.joins import left_join_many
from affinia.operators.scale import exact_quantiles
from affinia.session import materialise


# --- feedback --------------------------------------------------------------


def feedback(entities: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Entities with yearly feedback summed and feedback per review averaged.

    Reviews are summed per key before they meet the entities, so a hot key
    crosses the network as one row per task. Entities without reviews get 0.
    """
    totals = reviews.groupBy(key).agg(
        F.sum("ufc_count_per_year").alias("total_ufc_count_per_year"),
        F.avg("ufc_count").alias("avg_ufc_count_per_review"),
    )
    return entities.join(totals, key, "left").fillna(
        0.0, ["total_ufc_count_per_year", "avg_ufc_count_per_review"]
    )


def avg_useful(reviews: DataFrame) -> DataFrame:
    """Mean `useful` votes per business."""
    return reviews.groupBy("business_id").agg(F.avg("useful").alias("avg_useful_score"))


# --- categories ------------------------------------------------------------


def exploded_categories(businesses: DataFrame) -> DataFrame:
    """(business_id, category), one row per token, repeated tokens kept."""
    return businesses.select("business_id", F.explode(clean_categories("categories")).alias("category"))


def category_edges(businesses: DataFrame) -> DataFrame:
    """(type, bid_cat): MD5 of the category to the tagged business, plus one self
    edge per business that has a category."""
    tagged = exploded_categories(businesses).select(
        F.md5("category").alias("type"), with_suffix("business_id", "_bid").alias("bid_cat")
    )
    own = tagged.select(F.col("bid_cat").alias("type"), "bid_cat").distinct()
    return tagged.unionByName(own)


def category_dictionary(businesses: DataFrame) -> DataFrame:
    """Distinct category with its MD5."""
    tokens = exploded_categories(businesses).select("category").distinct()
    return tokens.withColumn("category_md5", F.md5("category"))


def category_user_map(businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """category, md5, business and user, one row per review of each category.

    Every category edge carries its own text, so the dictionary needs no join;
    self edges match no category and never show up.
    """
    edges = exploded_categories(businesses).withColumn("category_md5", F.md5("category"))
    return left_join_many(edges, reviews.select("user_id", "business_id"), "business_id").select(
        "category", "category_md5", "business_id", "user_id"
    )


def category_sets(category_users: DataFrame) -> DataFrame:
    """Distinct businesses and users per category; a null user does not count.

    Repeated visits change nothing here, so the map may be built from distinct
    (user, business) pairs.
    """
    return category_users.groupBy("category", "category_md5").agg(
        F.count_distinct("business_id").alias("n_businesses"),
        F.count_distinct("user_id").alias("n_users"),
    )


def visited_category_sets(businesses: DataFrame, pairs: DataFrame) -> DataFrame:
    """`category_sets` of the map over (user, business) pairs, without the rows of the map.

    Businesses are counted on the category edges. A pair goes to its user with the list of its business's
    categories, and a user names every category once.
    """
    edges = materialise(exploded_categories(businesses).distinct(), "categories")
    lists = edges.groupBy("business_id").agg(F.collect_list("category").alias("categories"))  # an entry per category
    visits = pairs.where(F.col("user_id").isNotNull()).join(lists, "business_id").select("user_id", "categories").repartition("user_id")
    named = visits.select("user_id", F.explode("categories").alias("category")).distinct()
    users = named.groupBy("category").agg(F.count("*").alias("n_users"))
    sizes = edges.groupBy("category").agg(F.count("business_id").alias("n_businesses"))
    return sizes.join(users, "category", "left").select(
        "category", F.md5("category").alias("category_md5"), "n_businesses", F.coalesce("n_users", F.lit(0)).alias("n_users")
    )


def _business_share(businesses: DataFrame) -> DataFrame:
    """Category rows over all businesses. Rows are exploded tokens, so a token that
    a business lists twice counts twice."""
    total = businesses.agg(F.count_distinct("business_id")).scalar()
    rows = exploded_categories(businesses).groupBy("category").agg(F.count("*").alias("rows"))
    return rows.select("category", (F.col("rows") / total).alias("proportion"))


def top_categories(category_users: DataFrame, businesses: DataFrame, k: int = 10, desc: bool = True) -> DataFrame:
    """Categories with the most (or fewest) businesses, with users and share."""
    order = F.desc("n_businesses") if desc else F.asc("n_businesses")
    best = category_sets(category_users).orderBy(order, "category").limit(k)
    return best.join(_business_share(businesses), "category").select(
        "category", F.col("n_businesses").alias("business_count"), F.col("n_users").alias("user_count"), "proportion"
    )


def top_categories_by(
    category_users: DataFrame, businesses: DataFrame, dimension: str, total_users=None, k: int = 10, desc: bool = True
) -> DataFrame:
    """Top categories by 'business' or 'user'; the user share needs the user total."""
    if dimension not in ("business", "user"):
        raise ValueError(f"unknown dimension {dimension!r}")
    if dimension == "user" and total_users is None:
        raise ValueError("the 'user' dimension needs the total number of users")
    count = "n_businesses" if dimension == "business" else "n_users"
    order = F.desc(count) if desc else F.asc(count)
    best = category_sets(category_users).orderBy(order, "category").limit(k)
    if dimension == "business":
        best = best.join(_business_share(businesses), "category")
    else:
        total = total_users if not isinstance(total_users, int) else F.lit(total_users)
        best = best.withColumn("proportion", F.col("n_users") / total)
    return best.select("category", F.col(count).alias(f"{dimension}_count"), "proportion")


def inverted_index(businesses: DataFrame) -> DataFrame:
    """Category <-> business edges with the size of either side.

    Sets per category would hold a hot category in one row; the edges do not.
    """
    edges = exploded_categories(businesses).distinct()
    per_category = edges.groupBy("category").agg(F.count("*").alias("n_businesses"))
    per_business = edges.groupBy("business_id").agg(F.count("*").alias("n_categories"))
    return edges.join(per_category, "category").join(per_business, "business_id")


# --- pooling ---------------------------------------------------------------


def pool(
    vectors: DataFrame, key: str, vec: str, dim: int, how: str = "mean",
    ids: DataFrame | None = None, skip_zeros: bool = True,
) -> DataFrame:
    """Mean or element-wise maximum of the vectors of a key.

    Zero vectors stand for failed encodings and are skipped; an id of `ids`
    without any vector left gets zeros. `Summarizer` merges partial vectors
    map-side, one per key and task.
    """
    used = vectors.where(F.col(vec).isNotNull())
    if skip_zeros:
        used = used.where(~is_zero(vec))
    summary = {"mean": Summarizer.mean, "max": Summarizer.max}[how]
    pooled = (
        used.withColumn("_v", array_to_vector(vec))
        .groupBy(key)
        .agg(summary(F.col("_v")).alias("_p"))
        .select(key, vector_to_array("_p").alias("features"))
    )
    if ids is None:
        return pooled
    return ids.select(key).distinct().join(pooled, key, "left").select(
        key, F.coalesce("features", zeros(dim)).alias("features")
    )


def photo_lists(photos: DataFrame) -> DataFrame:
    """Photos of each business, one row per photo with the list length."""
    sizes = photos.groupBy("business_id").agg(F.count("*").alias("n_photos"))
    return photos.select("business_id", "photo_id").join(sizes, "business_id")


def positives(df: DataFrame) -> DataFrame:
    """Distinct (user, business) pairs with the size of the user's set."""
    pairs = df.select("user_id", "business_id").distinct()
    sizes = pairs.groupBy("user_id").agg(F.count("*").alias("n_positives"))
    return pairs.join(sizes, "user_id")


def mean_location(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


# --- summaries -------------------------------------------------------------

QUARTILES = [0.25, 0.5, 0.75]


def profile(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per group and feature."""
    long = df.select(
        *by, F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))]))
        .alias("feature", "value"),
    )
    keys = [*by, "feature"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    at = exact_quantiles(long, keys, "value", QUARTILES).groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(f"q{int(p * 100)}") for p in QUARTILES]
    )
    return moments.join(at, keys, "left")


def share(df: DataFrame, col: str) -> DataFrame:
    """Rows per value and their percentage of all rows."""
    total = df.agg(F.count("*")).scalar()
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.col("n") / total * 100.0)


def corr_table(df: DataFrame, params: list[str], target: str) -> DataFrame:
    """Pearson correlation of each parameter with the target, one pass."""
    wide = df.agg(*[F.corr(p, target).alias(p) for p in params])
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("r")) for p in params])
    return wide.select(F.explode(pairs).alias("x")).select("x.param", "x.r")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(key)


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols], F.count("*").alias("n_rows"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
