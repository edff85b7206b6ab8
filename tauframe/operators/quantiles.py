"""Exact linear-interpolation percentiles per group.

Value counts are put in order with running totals, so no task has to hold the values
of a group; the order statistics beside each share are then picked by aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauframe.operators.ordered import running_totals


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def percentiles(
    counts: DataFrame, by: list[str], value: str, shares: list[float], keep: int = 10
) -> DataFrame:
    """Percentiles of ``counts`` with the distinct count and the ``keep`` smallest values."""
    if not by:
        whole = percentiles(
            counts.withColumn("_all", F.lit(0)), ["_all"], value, shares, keep
        )
        return whole.drop("_all")
    ranked = running_totals(
        counts, [F.col(value)], {"through": F.col("n")}, by=by, position="rank", with_totals=True
    )
    placed = ranked.withColumnRenamed("through_total", "rows")
    start = F.col("through") - F.col("n")

    def at(share: float, step: int) -> Column:
        place = F.floor(F.lit(float(share)) * (F.col("rows") - 1)) + step
        inside = (start <= place) & (place < F.col("through"))
        return F.max(F.when(inside, F.col(value)))

    parts = []
    for i, share in enumerate(shares):
        parts += [at(share, 0).alias(f"_lo{i}"), at(share, 1).alias(f"_hi{i}")]
    stats = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.max("rows").alias("rows"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= keep, F.col(value)))).alias("lowest"),
        *parts,
    )
    interpolated = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("rows") - 1)
        low = F.col(f"_lo{i}")
        high = F.coalesce(F.col(f"_hi{i}"), low)
        interpolated.append(low + (place - F.floor(place)) * (high - low))
    return stats.select(
        *by, "distinct_values", F.array(*interpolated).alias("percentiles"), "lowest"
    )


def grouped_percentiles(
    df: DataFrame, by: list[str], value: str, shares: list[float], keep: int = 10
) -> DataFrame:
    """Percentiles of ``value`` per group."""
    return percentiles(value_counts(df, by, value), by, value, shares, keep)
