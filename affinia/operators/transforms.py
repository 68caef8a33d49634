"""Feature transforms, splits and samples."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.functions.scalars import NO_LETTERS, hash32
from affinia.functions.vectors import l2_normalize, zeros
from affinia.operators.aggregates import exploded_categories
from affinia.operators.scale import bucketed_row_number, slices

HASH_SPAN = 2**32


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation; a column without variance becomes 0."""
    stats = df.agg(F.struct(*[f for c in cols for f in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])).scalar()
    out = df.withColumn("_st", stats)
    for c in cols:
        spread = F.col(f"_st.{c}_s")
        out = out.withColumn(
            c + suffix, F.when(spread > 0, (F.col(c) - F.col(f"_st.{c}_m")) / F.nullif(spread, F.lit(0.0)))
            .otherwise(F.col(c) * 0.0),
        )
    return out.drop("_st")


def multi_hot(businesses: DataFrame) -> DataFrame:
    """Category indicators in long form: (business_id, category, value 1)."""
    return exploded_categories(businesses).where("category <> ''").distinct().withColumn("value", F.lit(1))


def assemble(cols: list[str | Column]) -> Column:
    """Numbers and vectors joined into one array<double>, in the given order."""
    return F.concat(*[F.col(c).cast("array<double>") if isinstance(c, str) else c for c in cols])


def numbers(*cols: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def city_matrix(visits: DataFrame, businesses: DataFrame) -> DataFrame:
    """(user_id, city, visits): distinct businesses a user visited per city.

    The wide matrix is kept sparse, a row per non-zero cell; an empty city is
    skipped.
    """
    cities = businesses.where("city <> ''").select("business_id", "city")
    return (
        visits.select("user_id", "business_id").where("user_id is not null").distinct()
        .join(cities, "business_id")
        .groupBy("user_id", "city").agg(F.count("*").alias("visits"))
    )


def pca(df: DataFrame, key: str, cols: list[str], k: int = 2) -> DataFrame:
    """Scores on the first k principal components of centred columns: (key, components).

    One pass gives the mean of every column and the covariance of every two, sums that merge between tasks;
    the driver gets these numbers alone. A component's largest entry is positive (the first on a tie). A row
    with a null in a column has no components; without rows nothing is returned.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    whole = df.where(functools.reduce(lambda a, b: a & b, [v.isNotNull() for v in x.values()]))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    found = whole.agg(
        *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(x.values())],
        *[F.covar_pop(x[cols[i]], x[cols[j]]).alias(f"c_{i}_{j}") for i, j in pairs],
    ).first()  # one row
    covariance = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = found[f"c_{i}_{j}"] or 0.0
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :k].T
    axes = [axis if axis[np.abs(axis).argmax()] > 0 else -axis for axis in axes]
    centred = [v - F.lit(found[f"m_{i}"]) for i, v in enumerate(x.values())]
    scores = [functools.reduce(lambda a, b: a + b, [v * F.lit(float(w)) for v, w in zip(centred, axis)]) for axis in axes]
    return df.select(key, F.when(functools.reduce(lambda a, b: a & b, [v.isNotNull() for v in x.values()]), F.array(*scores)).alias("components"))


def word_vectors(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, embedding) of the texts that hold a word: counts of hashed words, unit length.

    Words are counted per text and bucket before anything is shuffled, so a text
    of any length moves `dim` rows at most.
    """
    words = df.select(key, F.explode(F.split(text, NO_LETTERS)).alias("w")).where("w <> ''")
    bucket = F.conv(F.substring(F.md5(F.lower("w")), 1, 8), 16, 10).cast("bigint") % F.lit(dim)
    counts = words.groupBy(key, bucket.cast("int").alias("pos")).agg(F.count("*").cast("double").alias("x"))
    listed = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return listed.select(key, dense.alias("v")).select(key, l2_normalize("v").alias("embedding"))


def embed_text(
    df: DataFrame, key: str, text: str, dim: int = 64, encoder: Callable[[pd.Series], pd.Series] | None = None
) -> DataFrame:
    """(key, embedding): one vector per text, zeros for blank text.

    Without an encoder the whole text becomes a hashed bag of words. An encoder
    maps a batch of texts to vectors; it is set up once per task.
    """
    if encoder is None:
        vectors = df.select(key).join(word_vectors(df, key, text, dim), key, "left")
        return vectors.select(key, F.coalesce("embedding", zeros(dim)).alias("embedding"))
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    return df.select(key, F.when(blank, zeros(dim)).otherwise(_batched(encoder)(F.col(text))).alias("embedding"))


def embed_images(images: DataFrame, dim: int, encoder: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """One vector per (photo_id, content), zeros where the encoder gives none."""
    return images.select("photo_id", F.coalesce(_batched(encoder)(F.col("content")), zeros(dim)).alias("embedding"))


def image_table(photos: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Photos with their vector; zeros for a photo that is missing or could not be encoded."""
    return photos.join(vectors.select("photo_id", "embedding"), "photo_id", "left").withColumn(
        "embedding", F.coalesce("embedding", zeros(dim))
    )


def _batched(encoder: Callable[[pd.Series], pd.Series]):
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encoder(batch)

    return run


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (classes x rows of the class), per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "n", (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("weight")
    )


# --- splits and samples ----------------------------------------------------


def split_edge(share: float) -> int:
    """The 32-bit hash below which this share of all keys lies."""
    return round(share * 2**32)


def hash_split(df: DataFrame, key: list[str], fractions: dict[str, float], seed: int = 42, out: str = "split") -> DataFrame:
    """Name of the split of every row, by hash of its key: the same in every run. The fractions add up to 1."""
    if abs(sum(fractions.values()) - 1) > 1e-9 or min(fractions.values()) < 0:
        raise ValueError(f"fractions must add up to 1: {fractions}")
    u = hash32(F.lit(seed), *key)
    names, edge = list(fractions), 0.0
    label = F.lit(names[-1])
    cuts = []
    for name in names[:-1]:
        edge += fractions[name]
        cuts.append((name, split_edge(edge)))
    for name, cut in reversed(cuts):
        label = F.when(u < F.lit(cut), F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Train/test split that keeps the share of each label exactly.

    Rows are ranked by hash inside their label. Labels are few and all of them
    hot, so the rank is built over slices of the hash range, more for more rows.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n_label"))
    hashed = df.join(sizes, label).withColumn("h", hash32(F.lit(seed), key)).withColumn(
        "bucket", F.floor(F.col("h") * slices(F.col("n_label")) / F.lit(HASH_SPAN))
    )
    ranked = bucketed_row_number(hashed, [label], "bucket", ["h", key], "rn")
    train = F.col("rn") <= F.floor(F.col("n_label") * F.lit(fraction) + F.lit(0.5))
    return ranked.withColumn("split", F.when(train, "train").otherwise("test")).drop(
        "h", "bucket", "rn", "n_label"
    )


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of n rows: the n smallest key hashes."""
    return df.orderBy(hash32(F.lit(seed), key), key).limit(n)


def first_per(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """First row of each key under an explicit order, as a mergeable minimum."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")
