"""Shared folders, materialisation and batch bounds for the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.session import checkpoint

#: Rows and bytes in an Arrow batch; a single longer row is a batch of its own.
BATCH_ROWS = 512
BATCH_BYTES = "8m"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder every executor can reach.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary one; a cluster must name its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="tauframe-llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``shared_folder`` through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that a checkpoint has replaced.

    It does so only once the driver has collected their plans as garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(work: Callable) -> Callable:
    """``work`` on a task's batches; at its end the Python worker gives free memory back.

    Spark uses workers again: without this each of an executor's keeps the most that any
    stage before has taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for batches of very long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or a longer name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def as_scan(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain scan of Parquet files, else a scan of a copy in the shared folder."""
    try:
        df.select(_place())
        return df
    except AnalysisException:
        path = shared_folder(df.sparkSession, "located")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def with_locator(df: DataFrame, name: str) -> DataFrame:
    """``df`` with each row's place, a struct (file, row), as column ``name``.

    The place comes from the scanned Parquet files, so it is the same in every later
    scan, however the files are split and whichever executors are left. A frame that is
    not a plain scan of Parquet files is written to the shared folder first.
    """
    return as_scan(df).withColumn(name, _place())
