"""Exact positions and running totals over a global order.

A window without ``partitionBy`` runs in one task. Here the rows are cut into
contiguous buckets of the order first, windows run inside the buckets, and the
small per-bucket totals are turned into offsets for the buckets that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.session import checkpoint

BUCKET = "_bucket"


def _range_buckets(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    # Range bounds are sampled per execution, so the assignment is frozen on
    # storage before it is read twice. Ordering columns end in a unique id,
    # hence a heavily tied score is spread over several buckets.
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order)
    return checkpoint(ranged.withColumn(BUCKET, F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column] | None = None,
    by: tuple[str, ...] | list[str] = (),
    bucket: Column | None = None,
    position: str = "pos",
    with_totals: bool = False,
) -> DataFrame:
    """Add the 1-based ``position`` and inclusive running sums to every row.

    ``order`` must end in a unique key. ``by`` restarts the counts per group;
    rows with a null group are the caller's to drop. ``bucket`` is an optional
    integer that never decreases along ``order`` (for instance the high bits of
    an ordering hash); without it buckets come from a range partitioning.
    ``with_totals`` adds each sum over the whole group as ``<name>_total``, which
    spares a join on a group key that may be skewed.
    """
    by = list(by)
    sums = dict(sums or {})
    value_names = {name: f"_v_{name}" for name in sums}
    df = df.select("*", *[expr.alias(value_names[name]) for name, expr in sums.items()])
    bucketed = _range_buckets(df, by, order) if bucket is None else df.withColumn(BUCKET, bucket)

    keys = [*by, BUCKET]
    totals = bucketed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_t_{name}") for name, v in value_names.items()],
    )
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*by)).alias(f"{n}_total")
          for n in sums if with_totals],
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.select(
        "*",
        F.row_number().over(inside).alias("_local"),
        *[F.sum(v).over(upto).alias(f"_l_{n}") for n, v in value_names.items()],
    )
    # The big side leaves its window hash-partitioned and sorted on the join
    # keys, so this join adds no exchange for it.
    joined = local.join(offsets, keys)
    original = [c for c in df.columns if c not in value_names.values()]
    return joined.select(
        *original,
        (F.col("_before") + F.col("_local")).cast("long").alias(position),
        *[(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.col(f"{n}_total") for n in sums if with_totals],
    )


def hash_order(id_col: str, seed: int) -> Column:
    """A uniform, plan-independent sort key for reproducible random orders."""
    return F.xxhash64(F.col(id_col), F.lit(seed))


def hash_cell(hash_col: str, bits: int = 16) -> Column:
    """The top ``bits`` of a hash as a cell number that grows with the hash."""
    return F.shiftright(F.col(hash_col), 64 - bits).cast("int")
