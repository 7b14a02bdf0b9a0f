"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset (tests on local[n]), a new temporary folder is set.

    On a cluster an unset folder is an error: a machine-local folder would not survive a lost executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = getattr(shared_folder, "own", None)
    if found is None:
        found = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="parlance-")
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns a scan of it; the files go when the JVM ends.

    A lost executor costs a re-read, never a recomputation of what led here, and the scan has an exact size, so
    Spark broadcasts it in a join only when it is below the configured threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parlance-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in bounded memory.

    Batches end at BATCH_BYTES (a session setting, set where it is not), so that very long texts do not meet by the
    thousand; and a worker, which Spark keeps for later tasks, gives its free memory back when a task ends.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(lean, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body names it."""
    return F.transform(F.array(value), body)[0]


def reserve(df: DataFrame, *names: str) -> None:
    """Refuses input columns that the operator's own columns would clash with (names are case-insensitive)."""
    clash = {n.lower() for n in names} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already; rename them first")
