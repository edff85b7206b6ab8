"""Contiguous, byte-balanced shards from global prefix sums.

Rows are put in one global order by (digest of the text, id), so that equal texts
are neighbours. The order is cut into range partitions; the byte total of each
partition gives the offset of the next ones, and a row's offset is that of its
partition plus the running sum inside it. Shards are cut at equal targets of bytes.

A group of equal texts whose bytes stay below ``whole_share`` of a shard's target
is placed by its first byte, so it is never torn apart; a larger group (it could
hold a third of all rows) is cut at the target like any other run of rows. Shard
sizes hence differ from the target by ``whole_share`` of it plus one row at most.

Nulls: a null text has no bytes and counts as the empty text; a null id sorts first.
Repeated rows are sharded one by one. An empty table gives no rows. Columns of the
input other than id and text are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauframe.operators.ordered import running_totals
from tauframe.llm.storage import checkpoint

#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 8


def shard_by_bytes(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_share: float = 0.002,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, shard_first_byte) for every row.

    ``slot`` counts the rows of a shard from 0 without gaps, in the global order.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("_digest"), F.col("doc_id"), F.col("_row")]
    placed = running_totals(rows, order, sums={"_upto": F.col("size")}, position="_pos")
    placed = checkpoint(placed.withColumn("_from", F.col("_upto") - F.col("size")))

    groups = placed.groupBy("_digest").agg(
        F.min("_from").alias("_first"), F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    copies = groups.filter("_n > 1").select("_digest", "_first", "_bytes")
    total = placed.agg(F.sum("size")).first()[0] or 1
    target = F.lit(total) / shards
    start = F.when(F.col("_bytes") <= F.lit(total) * whole_share / shards, F.col("_first")).otherwise(F.col("_from"))
    sharded = placed.join(copies, "_digest", "left").withColumn(
        "shard", F.least(F.floor(start / target), F.lit(shards - 1)).cast("int"))
    # At most one row for each shard.
    first = F.broadcast(sharded.groupBy("shard").agg(
        F.min("_pos").alias("_shard_pos"), F.min("_from").alias("shard_first_byte")))
    return sharded.join(first, "shard").select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("_pos") - F.col("_shard_pos")).cast("long").alias("slot"), "shard_first_byte")


__all__ = ["ROW_OVERHEAD", "shard_by_bytes"]
