"""Line dedup: keep a repeated line only in the smallest document that holds it.

Every line becomes a 128-bit key; the keys are range-partitioned and sorted by
key, document and position, so the first document of a key comes first and one
pass over the sorted rows names every line to drop. A key that holds a large
share of all lines is spread over many ranges: its first document comes from a
map-side minimum instead. What leaves the sort is, per document, a run-length
compressed bitmap: the runs of dropped line numbers. Texts are never sorted.

All of it is built-in column functions.

Defined results: a null or empty text is one empty line; lines shorter than
`min_chars` always stay; rows without an id take no part and lose nothing; rows
that repeat an id are one document, each row keeps its own bitmap; an empty
table gives an empty table. Only the id and text columns are read, so other
columns may have any name; a column named like one of the counts is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinia.llm.names import free_name
from affinia.session import materialise

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A key with more lines than this, and more than a quarter of a partition's share, is spread.
HOT_LINES = 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _row, _text): `_row` tells apart rows that repeat an id."""
    return docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text")
    )


def dropped_lines(rows: DataFrame, min_chars: int, hot_lines: int) -> DataFrame:
    """(_id, _row, pos) of every line that a smaller document holds too."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # read by the counts, by the sample that finds the ranges, and by the sort
    lines = materialise(
        rows.where(F.col("_id").isNotNull())
        .select("_id", "_row", F.posexplode(lines_of(F.col("_text"))).alias("pos", "line"))
        .select("_id", "_row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("_id", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "lines",
    )
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("_id").alias("hot_first"))
    share = counts.agg((F.sum("n") / F.lit(4 * parts)).alias("share")).scalar()
    # each of these keys holds more than 1 / (4 parts) of the lines, so there are fewer than 4 parts of them
    hot = counts.where((F.col("n") > hot_lines) & (F.col("n") > share)).select("h1", "h2", "hot_first")
    salted = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn(
        "salt", F.when(F.col("hot_first").isNotNull(), F.pmod(F.xxhash64("_id", "pos"), F.lit(4 * parts))).otherwise(0)
    )
    order = W.partitionBy("h1", "h2", "salt").orderBy("_id", "pos")
    return (
        salted.repartitionByRange("h1", "h2", "salt")
        .withColumn("first", F.coalesce("hot_first", F.first("_id").over(order)))
        .where(F.col("_id") > F.col("first"))
        .select("_id", "_row", "pos")
        .distinct()  # rows that repeat both id and text
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, hot_lines: int = HOT_LINES
) -> DataFrame:
    """(_id, _row, n_dropped, dropped): runs of dropped line numbers, for the rows that lose a line."""
    dropped = dropped_lines(rows_of(docs, id_col, text_col), min_chars, hot_lines)
    in_row = W.partitionBy("_id", "_row").orderBy("pos")
    return (
        dropped.withColumn("run", F.col("pos") - F.row_number().over(in_row))
        .groupBy("_id", "_row", "run")
        .agg(F.min("pos").alias("start"), F.count("*").alias("n"))
        .groupBy("_id", "_row")
        .agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "n"))).alias("dropped"))
    )


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines outside the dropped runs, joined again; without runs the text itself."""
    lines = lines_of(text)

    def end(run: Column) -> Column:
        return run["start"] + run["n"]

    before = F.transform(
        dropped,
        lambda run, i: F.struct(
            F.when(i == 0, F.lit(0).cast("bigint")).otherwise(end(F.get(dropped, i - 1))).alias("a"),
            run["start"].cast("bigint").alias("b"),
        ),
    )
    last = F.struct(end(F.element_at(dropped, -1)).alias("a"), F.size(lines).cast("bigint").alias("b"))
    kept = F.flatten(
        F.transform(
            F.concat(before, F.array(last)),
            lambda s: F.slice(lines, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")),
        )
    )
    return F.when(dropped.isNull(), text).otherwise(F.array_join(kept, "\n"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
    lines_col: str = "_n_lines", dropped_col: str = "_n_dropped",
) -> DataFrame:
    """All rows and columns of `docs`, the text without its dropped lines, and the two counts."""
    keep_id, keep_row, keep_n, keep_runs = (free_name(docs, f"_keep_{x}") for x in ("id", "row", "n", "runs"))
    keep = keep_bitmaps(docs, id_col, text_col, min_chars).select(
        F.col("_id").alias(keep_id), F.col("_row").alias(keep_row), F.col("n_dropped").alias(keep_n),
        F.col("dropped").alias(keep_runs),
    )
    text = F.col(text_col)
    same = (F.col(id_col) == F.col(keep_id)) & (F.xxhash64(text) == F.col(keep_row))
    return (
        docs.join(keep, same, "left")
        .withColumn(lines_col, F.size(lines_of(text)).cast("bigint"))
        .withColumn(dropped_col, F.coalesce(keep_n, F.lit(0)).cast("bigint"))
        .withColumn(text_col, kept_text(text, F.col(keep_runs)))
        .drop(keep_id, keep_row, keep_n, keep_runs)
    )
