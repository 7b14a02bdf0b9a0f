"""Session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a settled table that a join may still hold in the driver and in every executor.
BROADCAST_ROWS = 200_000
#: Bytes of files that may hold more rows than that, and that Spark would broadcast.
COUNTED = (64 << 10, 10 << 20)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where it is unset, a local session gets a temporary folder and a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="parlance-checkpoints-"))


def settled(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder as Parquet, and read from there; the files go when the JVM ends.

    Unlike a checkpoint it is packed by columns and Spark knows its size, so that joins broadcast it where it is small and only then: files
    tell little of what rows take in memory, so one of more than BROADCAST_ROWS rows is not broadcast either.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    found, size = spark.read.schema(df.schema).parquet(path), at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    between = COUNTED[0] <= size < COUNTED[1]  # larger files are not broadcast; the count reads footers only
    return found.hint("merge") if between and found.count() > BROADCAST_ROWS else found
