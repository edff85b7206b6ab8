"""Exact deduplication as a stateful stream, native Spark throughout.

The documents become a table of (id, digest, locator) that a stream reads file by
file. Its state, one entry for each digest, is kept on disk by the RocksDB state store
and written to the stream's checkpoint in the shared folder; no watermark is set, so no
entry expires. An entry holds the digest, the stable identifier of the document that
stays, the locator of its content and the number of rows seen. The finished state is read
back with the state data source. Rows that hit an entry with other rows are then
checked byte for byte against the content that the locator names; rows whose bytes
differ (a collision of digests) are grouped by their bytes instead.

Choices: a null text counts as empty. The row with the largest (or smallest) id stays;
null ids come last. A row that repeats both id and text is a copy like any other: each
such row is returned, ``kept`` marks the one whose locator the state holds. Columns other
than id and text are not read. An empty table gives no rows. The locator is a row's file
and position in it; a frame that is not a scan of files is written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.llm.storage import checkpoint, delete_folder, free_name, shared_folder, with_locator

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Files of small partitions must not reserve megabytes that stay empty.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All partitions of an executor share one bound; each is closed when its task ends.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Rows of one group of equal texts that share a copy of the kept text in the byte check.
ROWS_PER_COPY = 500


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank(keep: str) -> Column:
    """What is compared to choose the row that stays; a flag puts null ids last."""
    known = F.col("_id").isNotNull() if keep == "largest" else F.col("_id").isNull()
    return F.struct(known.alias("known"), F.col("_id").alias("id"), F.col("_at").alias("at"))


def stream_state(
    spark: SparkSession, keys: DataFrame, keep: str, files_per_trigger: int
) -> DataFrame:
    """Run the keyed stream over ``keys`` to its end; the state as a frame.

    ``keys`` has _id, _digest and _at. Returned: _digest, keep_id, keep_at, group_size.
    """
    source, state = shared_folder(spark, "dedup-keys"), shared_folder(spark, "dedup-state")
    keys.write.parquet(source)
    pick = F.max if keep == "largest" else F.min
    best = pick(_rank(keep))
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        stream = (
            spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(source).groupBy("_digest")
            .agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        )
        run = (
            stream.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        run.awaitTermination()
        entries = spark.read.format("statestore").load(state)
        kept, count = entries.schema["value"].dataType.names
        groups = checkpoint(entries.select(
            F.col("key")["_digest"].alias("_digest"),
            F.col("value")[kept]["id"].alias("keep_id"),
            F.col("value")[kept]["at"].alias("keep_at"),
            F.col("value")[count].alias("group_size"),
        ))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    delete_folder(spark, source)
    delete_folder(spark, state)
    return groups


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    normalise=lambda text: text,
    digest=sha256_text,
    files_per_trigger: int = 256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, at, bytes_checked.

    ``normalise`` and ``digest`` map a text column to the text compared and to the key of
    the state. ``at`` is the row's locator.
    """
    spark = docs.sparkSession
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    located = with_locator(docs.select(id_col, text_col), "_at").select(
        F.col(id_col).alias("_id"), text.alias("_text"), digest(text).alias("_digest"), "_at")
    keys = checkpoint(located.select(
        "_id", "_digest", "_at", sha256_text(F.col("_text")).alias("text_sha256")))
    groups = stream_state(spark, keys.select("_id", "_digest", "_at"), keep, files_per_trigger)
    marked = checkpoint(keys.join(groups, "_digest"))

    # Only rows of groups of two and more are compared, each group's rows in lots that
    # have their own copy of the kept text: a huge group is many small comparisons.
    hits = marked.filter("group_size > 1").select("_at", "_digest", "_id", "keep_at", "group_size")
    lots = F.ceil(F.col("group_size") / ROWS_PER_COPY).cast("long")
    texts = located.select("_at", "_text").join(
        hits.select("_at", "_digest", "_id", "keep_at", lots.alias("_lots")), "_at")
    held = checkpoint(texts)
    kept = held.filter("_at = keep_at").select(
        "_digest", F.col("_text").alias("_kept_text"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1)).alias("_lot"))
    compared = held.withColumn("_lot", F.pmod(F.xxhash64("_at"), F.col("_lots"))).join(kept, ["_digest", "_lot"])
    differ = compared.filter(F.col("_text").cast("binary") != F.col("_kept_text").cast("binary"))
    collided = checkpoint(differ.select("_at", "_digest", "_id", "_text"))
    if not collided.isEmpty():
        marked = _regroup(marked, collided, keep)
    return marked.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size",
        (F.col("_at") == F.col("keep_at")).alias("kept"), "text_sha256",
        F.col("_at").alias("at"), (F.col("group_size") > 1).alias("bytes_checked"))


def _regroup(marked: DataFrame, collided: DataFrame, keep: str) -> DataFrame:
    """Give rows whose digest hit other bytes the group of their own bytes."""
    pick = F.max if keep == "largest" else F.min
    groups = collided.groupBy("_text").agg(
        pick(_rank(keep)).alias("b"), F.count(F.lit(1)).alias("_n"))
    own = collided.join(groups, "_text").select(
        "_at", F.col("b.id").alias("_own_id"), F.col("b.at").alias("_own_at"), "_n")
    lost = collided.groupBy("_digest").agg(F.count(F.lit(1)).alias("_gone"))
    moved = F.col("_n").isNotNull()
    return checkpoint(marked.join(own, "_at", "left").join(lost, "_digest", "left").select(
        "_at", "_digest", "_id", "text_sha256",
        F.when(moved, F.col("_own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(moved, F.col("_own_at")).otherwise(F.col("keep_at")).alias("keep_at"),
        F.when(moved, F.col("_n")).otherwise(
            F.col("group_size") - F.coalesce(F.col("_gone"), F.lit(0))).alias("group_size")))


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """``docs`` without the rows whose text another row keeps."""
    at = free_name(docs, "_at")
    located = with_locator(docs, at)
    result = exact_duplicates(located.drop(at), id_col, text_col, keep)
    stays = result.filter("kept").select(F.col("at").alias(at))
    return located.join(stays, at, "left_semi").select(docs.columns)
