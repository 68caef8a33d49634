"""Prediction error: RMSE, buckets, confusion, error structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.functions.scalars import STAR_LABELS, clip, round_stars, star_bucket
from affinia.operators.interactions import PAIR
from affinia.operators.scale import exact_quantiles

STARS = [1.0, 2.0, 3.0, 4.0, 5.0]


def rmse_of(prediction: Column | str, truth: Column | str = "stars") -> Column:
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    t = F.col(truth) if isinstance(truth, str) else truth
    return F.sqrt(F.avg((p - t) * (p - t)))


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("error", F.col("prediction") - F.col("stars"))


def rmse(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Root mean squared error after the join on the pair."""
    both = truth.join(predictions, PAIR)
    return both.agg(F.count("*").alias("n"), rmse_of("prediction").alias("rmse"))


def rmse_by(df: DataFrame, key: str) -> DataFrame:
    """RMSE per group and, under a null group, overall.

    Squared errors are summed per group once; the overall value adds the sums.
    """
    d = F.col("prediction") - F.col("stars")
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(d * d).alias("sq"))
    overall = sums.agg(F.lit(None).cast(sums.schema[key].dataType).alias(key), F.sum("n").alias("n"), F.sum("sq").alias("sq"))
    return sums.withColumn("scope", F.lit("group")).unionByName(overall.withColumn("scope", F.lit("overall"))).select(
        "scope", key, "n", F.sqrt(F.col("sq") / F.col("n")).alias("rmse")
    )


def rmse_variants(df: DataFrame) -> DataFrame:
    """RMSE raw, clipped, rounded and cut at five, in one pass."""
    p = F.col("prediction")
    forms = {
        "raw": p, "clipped": clip(p), "rounded": round_stars(p), "cut_at_five": clip(p, low=None),
    }
    wide = df.agg(*[rmse_of(c).alias(name) for name, c in forms.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("rmse")) for n in forms])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts per (label, predicted) and their share of the label."""
    counts = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    totals = counts.groupBy(label).agg(F.sum("n").alias("_total"))
    return counts.join(totals, label).select(label, predicted, "n", (F.col("n") / F.col("_total")).alias("share"))


def star_confusion(df: DataFrame) -> DataFrame:
    """Rows per true star and predicted bucket, empty cells listed as 0."""
    counted = (
        df.where(F.col("stars").isin(STARS))
        .groupBy("stars", star_bucket("prediction").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("stars"), F.lit(b).alias("bucket")) for s in STARS for b in STAR_LABELS]))
    grid = df.sparkSession.range(1).select(cells.alias("x")).select("x.*")
    return grid.join(counted, ["stars", "bucket"], "left").select("stars", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def overpredicted(df: DataFrame) -> DataFrame:
    """True one and two star rows that round to three or more."""
    rounded = round_stars("prediction")
    return df.where(F.col("stars").isin(1.0, 2.0) & (rounded >= 3)).withColumn("rounded_prediction", rounded)


def error_features(errors: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Error rows with chosen feature columns."""
    return errors.join(features.select(*PAIR, *names), PAIR)


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, median and 1.5 IQR whiskers of a value per group.

    Whiskers end at the outermost values inside the fences.
    """
    q = exact_quantiles(df, [by], value, [0.25, 0.5, 0.75]).groupBy(by).agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value).cast("double"))
    # equal values are counted before the quartiles join them
    return (
        df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
        .join(q, by)
        .groupBy(by)
        .agg(
            F.sum("c").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
            F.first("q3").alias("q3"), F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
        )
    )


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows that meet each named condition, from one pass."""
    wide = df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("filter_name"), F.col(n).alias("n")) for n in conditions])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def city_errors(errors: DataFrame) -> DataFrame:
    """Overpredicted rows and their RMSE per city, most errors first."""
    return errors.groupBy("city").agg(F.count("*").alias("n"), rmse_of("prediction").alias("rmse")).orderBy(
        F.desc("n"), "city"
    )


def city_lift(errors: DataFrame, businesses: DataFrame) -> DataFrame:
    """City share among the errors against its share among all businesses; null without errors."""
    n_errors = errors.agg(F.count("*")).scalar()
    n_businesses = businesses.agg(F.count("*")).scalar()
    e = errors.groupBy("city").agg(F.count("*").alias("n_errors"))
    b = businesses.groupBy("city").agg(F.count("*").alias("n_businesses"))
    return (
        b.join(e, "city", "left")
        .withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
        .withColumn("error_share", F.try_divide(F.col("n_errors"), n_errors))
        .withColumn("business_share", F.col("n_businesses") / n_businesses)
        .withColumn("lift", F.col("error_share") / F.col("business_share"))
    )


def value_counts(df: DataFrame, col: Column | str, name: str) -> DataFrame:
    return df.groupBy((F.col(col) if isinstance(col, str) else col).alias(name)).agg(F.count("*").alias("n")).orderBy(name)
