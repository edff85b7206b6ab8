"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tauframe")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        context.setCheckpointDir(folder)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tauframe-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A frame dealt out to every core.

    What a scan coalesces into a task or two is too few for work that multiplies
    each row, so the rows are dealt anew, by as many tasks as the session shuffles to.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def persist_spread(df: DataFrame) -> DataFrame:
    """Cache a frame that is about to be scanned many times, dealt out to every core."""
    cached = spread(df).persist()
    cached.count()
    return cached


#: Rows of a partition from which on more tasks are worth their start.
PARTITION_ROWS = 250_000


def persist_sized(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to read, frame to unpersist) for a fit that runs hundreds of short jobs.

    A job takes a task for each partition, so small tables must not come in many more of
    them than there are cores; large ones get one for each ``PARTITION_ROWS`` rows.
    """
    cached = df.persist()
    rows, parts = cached.count(), cached.rdd.getNumPartitions()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS))
    if parts > wanted:
        return cached.coalesce(wanted), cached
    if rows > parts * PARTITION_ROWS:
        dealt = cached.repartition(wanted).persist()
        dealt.count()
        cached.unpersist()
        return dealt, dealt
    return cached, cached
