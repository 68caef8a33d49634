"""A training corpus from raw documents: language, repeated lines, near duplicates, leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns the columns of documents; the last returns packed
pieces. Leaks are dropped row by row: by id and hash of the text, so that rows that
share an id, or have none, are judged each by its text. Near duplicates are judged
twice: by the texts of the table `documents`, as a copy that lost the lines it shares
to line dedup is still a copy, and then by the texts that are left, as documents that
differed in the lines they lost may be copies now.

An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.llm import decontaminate, langid, line_dedup, near_text, packing
from affinia.llm.names import free_name
from affinia.llm.queries import prepare, table, tokenizer_path
from affinia.session import materialise, passing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, which have no letters, and label those that have no label.

    Where no labelled row can be learned from, all documents stay as they are.
    """
    prepare(spark)
    names, logs = langid.fit(docs.where(~langid.held_out()))
    if not names:
        return docs
    out = free_name(docs, "_language")
    # evaluated once: the filter must not be pushed below it with a copy of it
    predict = langid.predictor(spark, names, logs).asNondeterministic()
    found = docs.withColumn(out, predict(F.col("text")))
    label = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.col(out)["lang_pred"])
    return found.where(F.col(out)["lang_pred"] != langid.UNKNOWN).withColumn("lang", label).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that a smaller document holds too out of the texts, and drop documents that have none left."""
    prepare(spark)
    dropped = free_name(docs, "_n_dropped")
    kept = line_dedup.drop_repeated_lines(docs, lines_col=free_name(docs, "_n_lines"), dropped_col=dropped)
    blank = (F.col(dropped) > 0) & F.coalesce(F.col("text"), F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z")
    return kept.where(~blank).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _without(docs: DataFrame, dropped) -> DataFrame:
    """The rows of `docs` without those that `dropped(rows, key column)` names."""
    key = free_name(docs, "_key")
    # rows without an id come after the others
    rows = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text")))
    gone = dropped(rows, key).select(F.col(key).alias("_gone")).distinct()
    return rows.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document that is left of every group of near duplicates.

    Groups are those of the whole texts in `documents`, and then, of the rows these leave, those of their own texts.
    """
    prepare(spark)
    with passing(spark):
        left = materialise(_without_whole_copies(spark, docs, sf_dir), "whole-texts-apart", keep=True)
    return _without(left, lambda rows, key: near_text.near_duplicates(rows, id_col=key).where(~F.col("kept")))


def _without_whole_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest row of every group of near duplicates among the whole texts in `documents`.

    A row whose id is not unique goes if all texts of its id go, or if its own text, unchanged, is one that goes.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"))
    whole = table(spark, sf_dir, "documents").select(key.alias("key"), "text")
    found = near_text.near_duplicates(whole, id_col="key").select("key", "component_id")
    present = docs.select(F.col("doc_id").alias("_id")).distinct()
    left = materialise(found.join(present, F.col("key.doc_id").eqNullSafe(F.col("_id")), "left_semi"), "groups-left")
    first = left.groupBy("component_id").agg(F.min("key").alias("first"))
    judged = left.join(first, "component_id").select("key.doc_id", F.col("key.text").alias("hash"), (F.col("key") != F.col("first")).alias("gone"))
    # a row per id, and one per text where there is no id
    at = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("hash")).alias("hash"))
    of_id = judged.groupBy(at.alias("_at")).agg(F.every("gone").alias("_all"), F.collect_set(F.when(F.col("gone"), F.col("hash"))).alias("_gone"))
    gone = of_id.where(F.size("_gone") > 0)
    own = F.xxhash64("text")
    same = F.struct("doc_id", F.when(F.col("doc_id").isNull(), own).alias("hash")).eqNullSafe(F.col("_at"))
    return docs.join(gone, same & (F.col("_all") | F.array_contains("_gone", own)), "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    prepare(spark)
    return _without(docs, lambda rows, key: decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("leaks", drop_leaks),
    ("pack", pack),
]

# Naive Bayes, register sketches and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
