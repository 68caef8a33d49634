"""Building blocks that keep ordered work away from one task.

A window partitioned by a hot key, or by nothing at all, ends in a single task.
The helpers here cut every ordered group into consecutive buckets, rank inside a
bucket, and add the number of rows in the buckets before it. They read their
input more than once, so they write it to the shared folder first: without that
the whole history of the input would be computed again for every use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinia.session import materialise

# Rows one window task should have to sort; hotter groups are cut into more buckets.
ROWS_PER_BUCKET = 1_000_000


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Distinct values of `col` numbered 0, 1, 2 ... in ascending order.

    The values are range-partitioned and sorted, and written once with their
    partition and their place in it; a value's number is its place plus the number
    of values in the partitions before, a table with one row per partition.
    """
    ids = df.where(F.col(col).isNotNull()).select(col).distinct().repartitionByRange(col).sortWithinPartitions(col)
    # the upper bits are the partition, the lower 33 count its rows
    placed = materialise(ids.withColumn("_at", F.monotonically_increasing_id()), "index")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").select(col, (place + F.col("_before")).alias(out))


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: str, order: list, out: str = "rn") -> DataFrame:
    """1-based row number per key, ranked bucket by bucket.

    `bucket` has to grow with the order: every row of a lower bucket sorts before
    every row of a higher one.
    """
    df = materialise(df, "ranked")
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order)))
    return (
        local.join(offsets, [*keys, bucket])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before")
    )


def slices(rows: Column) -> Column:
    """Number of buckets for a group of `rows` rows."""
    return F.lit(1) + F.floor(rows / F.lit(ROWS_PER_BUCKET))


# Cells that a bracket of a quantile is cut into.
CELLS = 1024


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per key: (keys, p, quantile). Nulls and NaN do not count.

    `percentile` would hold every distinct value of a group in one task. Here the values of each (key, p)
    start as one bracket, from the least to the largest. All brackets that hold more rows than a slice are
    cut into cells at once, the rows of every cell are counted map-side, and a bracket shrinks to the values
    of the cell that holds the wanted ranks. Two neighbouring ranks in different cells are the largest value
    of one and the least of the other. The ends of a bracket are values and lie in different cells, so each
    round leaves fewer; rounds alternate between even steps and even steps of the logarithm, which takes care
    of outliers. What remains, at most a slice per bracket, is sorted.
    """
    number = F.col(value).cast("double")
    flat = materialise(df.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("v")), "values")
    ends = flat.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = ends.where("n > 0").withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    h, none = (F.col("n") - 1) * F.col("p"), F.lit(None).cast("double")
    brackets = asked.select(*keys, "p", h.alias("h"), "lo", "hi", F.lit(0).cast("bigint").alias("before"), "n", none.alias("a"), none.alias("b"))
    even = True
    while True:
        brackets = materialise(brackets, "brackets")
        wide = (F.col("n") > ROWS_PER_BUCKET) & (F.col("lo") < F.col("hi")) & F.col("a").isNull()
        if brackets.where(wide).isEmpty():
            break
        brackets = brackets.where(~wide).unionByName(_narrower(flat, brackets.where(wide), keys, even))
        even = not even
    done = F.col("a").isNotNull() | (F.col("lo") == F.col("hi"))
    found = brackets.where(done).select(*keys, "p", "h", F.coalesce("a", "lo").alias("a"), F.coalesce("b", "lo").alias("b"))
    left = _inside(flat, brackets.where(~done), keys).groupBy(*keys, "p", "h", "before", "v").agg(F.count("*").alias("c"))
    upto = W.partitionBy(*keys, "p").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    placed = left.withColumn("end", F.col("before") + F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
    ranked = placed.groupBy(*keys, "p", "h").agg(
        *[F.max(F.when(_holds(rank), F.col("v"))).alias(name) for name, rank in (("a", F.floor("h")), ("b", F.ceil("h")))]
    )
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    return found.unionByName(ranked).select(*keys, "p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("quantile"))


def _holds(rank: Column) -> Column:
    return (F.col("start") <= rank) & (rank < F.col("end"))


def _inside(flat: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Every value with each bracket of its key that it lies in."""
    if keys:
        met = flat.join(brackets, keys)
    else:  # one bracket per probability, handed to every row as one small array
        listed = brackets.agg(F.collect_list(F.struct(*brackets.columns))).scalar()
        met = flat.withColumn("q", F.explode(listed)).select("v", "q.*")
    return met.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _narrower(flat: DataFrame, brackets: DataFrame, keys: list[str], even: bool) -> DataFrame:
    """The brackets shrunk to the cell with their ranks, or with `a` and `b` where these lie in two cells."""
    v, lo, hi = ((F.col(c) if even else F.asinh(c)) for c in ("v", "lo", "hi"))
    at = F.least(F.greatest(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * CELLS), F.lit(0)), F.lit(CELLS - 1))
    cell = F.when(F.col("v") == F.col("hi"), CELLS).when(F.col("v") == F.col("lo"), -1).otherwise(F.coalesce(at, F.lit(0)))
    counted = _inside(flat, brackets, keys).groupBy(*keys, "p", "h", "before", cell.cast("int").alias("cell")).agg(
        F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    upto = W.partitionBy(*keys, "p").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)  # a row per cell
    placed = counted.withColumn("end", F.col("before") + F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
    one, two = _holds(F.floor("h")), _holds(F.ceil("h"))
    picked = placed.groupBy(*keys, "p", "h").agg(
        *[F.max(F.when(one, F.col(c))).alias(name) for name, c in (("lo", "least"), ("hi", "most"), ("start", "start"), ("n", "c"))],
        F.max(F.when(two, F.col("start"))).alias("other"), F.max(F.when(two, F.col("least"))).alias("b"),
    )
    apart = F.col("start") < F.col("other")
    return picked.select(
        *keys, "p", "h", "lo", "hi", F.col("start").alias("before"), "n",
        F.when(apart, F.col("hi")).alias("a"), F.when(apart, F.col("b")).alias("b"),
    )
