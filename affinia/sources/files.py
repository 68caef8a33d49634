"""Readers and writers of the file formats the jobs exchange."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """Line-delimited JSON with a declared schema; unreadable lines are dropped.

    `limit` keeps the first records of the file order within a partition, which is
    all a distributed reader can promise.
    """
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.limit(limit)


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines `read_jsonl` drops, for a report."""
    wide = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(parsed[CORRUPT].isNotNull()).select(F.col("value").alias("line"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line; string fields are trimmed.

    Fields are taken by header name, so the pair file with or without the label
    column reads with one schema.
    """
    header = spark.read.option("header", True).csv(path).columns
    kinds = {f.name: f.dataType for f in schema.fields}
    layout = T.StructType([T.StructField(h, kinds.get(h.strip(), T.StringType())) for h in header])
    df = spark.read.schema(layout).option("header", True).csv(path)
    out = []
    for field in schema.fields:
        source = next((h for h in header if h.strip() == field.name), None)
        col = F.lit(None) if source is None else F.col(f"`{source}`")
        if isinstance(field.dataType, T.StringType):
            col = F.trim(col)
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, *order: str | Column) -> None:
    """CSV with a header line, globally sorted if an order is given."""
    (df.orderBy(*order) if order else df).write.option("header", True).mode("overwrite").csv(path)


def write_text(df: DataFrame, path: str, col: str) -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Typed cache of a frame; partitions that are written again replace the old ones."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Photo files as bytes, with the photo id cut from the file name."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(F.regexp_replace(name, r"\.jpg$", "").alias("photo_id"), "content")


def combine_pairs(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Train and validation pairs in one frame, duplicates kept."""
    return train.unionByName(validation)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, cls=PipelineModel):
    return cls.load(path)
