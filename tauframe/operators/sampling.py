"""Balanced samples, splits and folds that never depend on the plan.

Every random choice is a hash of the unit id and a seed, so a retried task or a
second evaluation of the same frame repeats it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.operators.ordered import hash_cell, hash_order, running_totals

SHARE_RESOLUTION = 1_000_000
CELL_BITS = 16


def take_by_hash(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, uniformly without replacement (all rows if fewer).

    Counts per hash cell locate the one cell that straddles ``n``; only that
    cell (1/65536 of the rows) is ranked, everything else is a filter.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_cell", hash_cell("_h", CELL_BITS))
    through = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))  # at most 65536 rows
        .select("_cell", "n", F.sum("n").over(through).alias("upto"))
        .where(F.col("upto") >= n)
        .orderBy("_cell").limit(1).first()
    )
    if edge is None:
        return hashed.drop("_h", "_cell")
    missing = n - (edge["upto"] - edge["n"])
    inside = Window.partitionBy("_cell").orderBy("_h", id_col)
    below = hashed.where(F.col("_cell") < edge["_cell"])
    partly = (
        hashed.where(F.col("_cell") == edge["_cell"])
        .withColumn("_r", F.row_number().over(inside))
        .where(F.col("_r") <= missing).drop("_r")
    )
    return below.unionByName(partly).drop("_h", "_cell")


def _arm_sizes(df: DataFrame, treatment: str) -> tuple[int, int]:
    row = df.agg(
        F.count_if(F.col(treatment) == 0).alias("c"), F.count_if(F.col(treatment) == 1).alias("t")
    ).first()
    return row["c"], row["t"]


def downsample_control(df: DataFrame, id_col: str, treatment: str, seed: int = 0) -> DataFrame:
    """Controls cut to the number of treated rows, with all treated rows."""
    _, treated = _arm_sizes(df, treatment)
    control = take_by_hash(df.where(F.col(treatment) == 0), id_col, treated, seed)
    return control.unionByName(df.where(F.col(treatment) == 1))


def downsample_larger_arm(
    df: DataFrame, id_col: str, treatment: str, seed: int = 40, shuffle_seed: int | None = None
) -> DataFrame:
    """Whichever arm is larger is cut to the size of the other.

    ``shuffle_seed`` also sorts the rows by a second hash, for consumers that
    want a random row order.
    """
    control, treated = _arm_sizes(df, treatment)
    larger = 0 if control > treated else 1
    kept = take_by_hash(df.where(F.col(treatment) == larger), id_col, min(control, treated), seed)
    out = kept.unionByName(df.where(F.col(treatment) == 1 - larger))
    return out if shuffle_seed is None else out.orderBy(hash_order(id_col, shuffle_seed), id_col)


def share_of(id_col: str, seed: int) -> Column:
    """A number in [0, 1) fixed by the id and the seed."""
    return F.pmod(hash_order(id_col, seed), F.lit(SHARE_RESOLUTION)) / F.lit(float(SHARE_RESOLUTION))


def flag_train(
    df: DataFrame, id_col: str, train_share: float, seed: int, name: str = "train"
) -> DataFrame:
    """Add a 1/0 train flag; an independent draw per unit."""
    return df.withColumn(name, (share_of(id_col, seed) < train_share).cast("int"))


def split(
    df: DataFrame, id_col: str, train_share: float = 0.67, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    share = share_of(id_col, seed)
    return df.where(share < train_share), df.where(share >= train_share)


def split_by_flag(df: DataFrame, flag: str | None, id_col: str, train_share=0.8, seed=25):
    """Train and test by an existing 1/0 column, or by a hash when there is none."""
    if flag is None:
        return split(df, id_col, train_share, seed)
    return df.where(F.col(flag) == 1), df.where(F.col(flag) == 0)


def honest_split(df: DataFrame, id_col: str, estimation_share: float = 0.5, seed: int = 0):
    """Rows that grow the tree and rows that estimate its leaves."""
    estimation, growth = split(df, id_col, estimation_share, seed)
    return growth, estimation


def stratified_folds(
    df: DataFrame, id_col: str, label: str, folds: int, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Shuffled folds whose label shares differ by at most one row."""
    hashed = df.withColumn("_h", hash_order(id_col, seed))
    placed = running_totals(
        hashed, [F.col("_h"), F.col(id_col)], by=[label], bucket=hash_cell("_h"), position="_p"
    )
    return placed.withColumn(name, F.pmod(F.col("_p") - 1, F.lit(folds)).cast("int")).drop("_h", "_p")


def random_columns(columns: list, size: int | None, seed) -> list:
    """A seeded subset of column positions for one tree node."""
    import random

    if not size or size >= len(columns):
        return list(columns)
    return sorted(random.Random(str(seed)).sample(list(columns), size))


def union_aligned(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name, missing ones null."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def assemble_test_set(train: DataFrame, predict: DataFrame, treatment: str) -> DataFrame:
    """Controls of the training table together with the table to be scored."""
    return union_aligned(train.where(F.col(treatment) == 0), predict)
