"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job relies on. They can be changed on a running session, so
# `tune` applies them to a session that somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows of ids shrink to a tenth in shuffle files: what a task sorts is bounded by less than the default of 64 MB
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of packed vectors are large: bound a batch by bytes, not by rows alone
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


_local_dir: str | None = None


def local_session(cores: int = 8, shuffle_partitions: int = 8, name: str = "affinia") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster.

    Only a local session may fall back on a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="affinia-")
    return _local_dir


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative fits (ALS, boosted trees) cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application's written tables, under the shared folder."""
    return os.path.join(shared_dir(spark), f"affinia-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path for one written table."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def release(spark: SparkSession) -> None:
    """Delete this application's written tables; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession):
    """Delete the tables that this thread writes inside once it is left, but those it keeps; frames that read them can't be used any more."""
    before = _passing.set([])
    try:
        yield
    finally:
        written = _passing.get()
        _passing.reset(before)
        for name in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df, name: str = "table", partition_by: str | None = None, keep: bool = False):
    """Write `df` once to the shared folder and read it back.

    Used where several fits read the same expensive rows: the lineage is cut and
    a lost executor only costs re-reading files. `keep` lets the table outlive `passing`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not keep and _passing.get() is not None:
        _passing.get().append(path)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
