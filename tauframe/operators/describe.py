"""Group statistics, balance tables, distributions and daily series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.functions.stats import (
    pooled_t,
    safe_divide,
    standardized_difference,
    t_p_value,
    z_p_value,
)
from tauframe.operators.quantiles import grouped_percentiles


def counts_by(df: DataFrame, key: str, columns) -> DataFrame:
    """Non-null counts of each column per group."""
    return df.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])


def means_by(df: DataFrame, keys, columns) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def arm_totals(df: DataFrame, treatment: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(treatment) == 1).alias("n_treatment"),
        F.count_if(F.col(treatment) == 0).alias("n_control"),
        F.count(F.lit(1)).alias("n"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def average_effect(df: DataFrame, treatment: str, outcome: str, by=()) -> DataFrame:
    """Difference of arm means, optionally per group (for instance train and test)."""
    t, y = F.col(treatment), F.col(outcome)
    return df.groupBy(*by).agg(
        (F.avg(F.when(t == 1, y)) - F.avg(F.when(t == 0, y))).alias("ate")
    )


def _moments(treatment: str, value: Column, prefix: str) -> list[Column]:
    out = []
    for arm in (0, 1):
        v = F.when(F.col(treatment) == arm, value)
        out += [
            F.count(v).alias(f"{prefix}n{arm}"),
            F.avg(v).alias(f"{prefix}m{arm}"),
            F.var_samp(v).alias(f"{prefix}v{arm}"),
        ]
    return out


def feature_moments(df: DataFrame, treatment: str, features, by=()) -> DataFrame:
    """Count, mean and sample variance per feature and arm, one row per feature.

    A single aggregation computes every feature of both arms, and only its one
    row per group is reshaped.
    """
    features = list(features)
    wide = df.groupBy(*by).agg(
        *[m for i, f in enumerate(features) for m in _moments(treatment, F.col(f), f"f{i}_")]
    )
    parts = ("n0", "m0", "v0", "n1", "m1", "v1")
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"f{i}_{p}").alias(p) for p in parts])
        for i, f in enumerate(features)
    ])
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def _stat_columns() -> dict[str, Column]:
    c = {k: F.col(k) for k in ("n0", "m0", "v0", "n1", "m1", "v1")}
    return {
        "smd": standardized_difference(c["m1"], c["v1"], c["n1"], c["m0"], c["v0"], c["n0"]),
        "t_stat": pooled_t(c["m0"], c["v0"], c["n0"], c["m1"], c["v1"], c["n1"]),
        "dof": (c["n0"] + c["n1"] - 2).cast("long"),
    }


def t_tests(df: DataFrame, treatment: str, features, by=()) -> DataFrame:
    """Equal-variance t of control minus treated, with degrees of freedom and p."""
    stats = _stat_columns()
    out = feature_moments(df, treatment, features, by).select(
        *by, "feature", stats["t_stat"].alias("t_stat"), stats["dof"].alias("dof")
    )
    return out.withColumn("p_value", t_p_value("t_stat", "dof"))


def compare_arms(df: DataFrame, treatment: str, outcome: str, alpha: float = 0.05) -> DataFrame:
    """Arm means of one outcome, the pooled t test and its verdict."""
    stats = _stat_columns()
    out = feature_moments(df, treatment, [outcome]).select(
        F.col("m0").alias("control_mean"),
        F.col("m1").alias("treatment_mean"),
        stats["t_stat"].alias("t_stat"),
        stats["dof"].alias("dof"),
    )
    out = out.withColumn("p_value", t_p_value("t_stat", "dof"))
    return out.withColumn("significant", ~(F.col("p_value") > alpha))


def balance_table(df: DataFrame, treatment: str, features, label: str = "before") -> DataFrame:
    """Signed standardized difference and p per feature."""
    stats = _stat_columns()
    out = feature_moments(df, treatment, features).select(
        "feature", F.lit(label).alias("matching"),
        stats["smd"].alias("smd"), stats["t_stat"].alias("t_stat"), stats["dof"].alias("dof"),
    )
    return out.select(
        "feature", "matching", "smd", t_p_value("t_stat", "dof").alias("p_value")
    )


def _pooled(groups: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Moments of the union of groups, each taken ``weight`` times, from their own moments.

    Squared deviations are those inside the groups plus those of the group means from the
    common mean, so nothing is subtracted that could cancel.
    """
    everyone = Window.partitionBy(*by)
    w = F.col(weight)
    means, sums = {}, []
    for arm in (0, 1):
        n, m, v = (F.col(f"{c}{arm}") for c in "nmv")
        means[f"_m{arm}"] = safe_divide(F.sum(w * n * m).over(everyone), F.sum(w * n).over(everyone))
        inside = F.coalesce(v * (n - 1), F.lit(0.0))
        off = F.coalesce(n * (m - F.col(f"_m{arm}")) ** 2, F.lit(0.0))
        total = F.sum(w * n)
        sums += [
            total.alias(f"n{arm}"), F.first(f"_m{arm}").alias(f"m{arm}"),
            F.when(total > 1, safe_divide(F.sum(w * (inside + off)), total - 1)).alias(f"v{arm}"),
        ]
    return groups.withColumns(means).groupBy(*by).agg(*sums)


def balance_before_after(df: DataFrame, copies: DataFrame, id_col: str, treatment: str, features) -> DataFrame:
    """Absolute standardized difference, p and arm sizes before and after matching.

    ``copies`` is (id, copies), see ``matching.pair_copies``. The matched sample is never
    made: one aggregation takes the moments of the rows that are in it equally often, and
    these few groups are pooled with weight one for "before" and with their number of
    copies for "after".
    """
    number = "_copies"
    counted = df.select(id_col, treatment, *features).join(
        copies.select(id_col, F.col("copies").alias(number)), id_col, "left")
    groups = feature_moments(counted, treatment, features, by=[number])
    sides = F.explode(F.array(
        F.struct(F.lit("before").alias("matching"), F.lit(1).cast("long").alias("weight")),
        F.struct(F.lit("after").alias("matching"), F.col(number).alias("weight")),
    )).alias("_side")
    weighed = groups.select("*", sides).select("*", "_side.*").where("weight is not null")
    stats = _stat_columns()
    out = _pooled(weighed, ["matching", "feature"], "weight").select(
        "feature", "matching", F.abs(stats["smd"]).alias("smd"),
        stats["t_stat"].alias("t_stat"), stats["dof"].alias("dof"),
        F.col("n1").alias("n_treatment"), F.col("n0").alias("n_control"),
    )
    return out.select(
        "feature", "matching", "smd",
        t_p_value("t_stat", "dof").alias("p_value"), "n_treatment", "n_control",
    )


def difference_in_differences(df: DataFrame, group: str, period: str, outcome: str) -> DataFrame:
    """(treated after - treated before) - (control after - control before)."""
    g, p, y = F.col(group), F.col(period), F.col(outcome)

    def cell(a, b):
        return F.avg(F.when((g == a) & (p == b), y))

    return df.agg(((cell(1, 1) - cell(1, 0)) - (cell(0, 1) - cell(0, 0))).alias("effect"))


def arm_moments(df: DataFrame, keys, treatment: str, outcome: str) -> DataFrame:
    """Sum, count and population variance of the outcome per group and arm."""
    return df.groupBy(*keys, treatment).agg(
        F.sum(outcome).alias("sum_y"),
        F.count(outcome).alias("n"),
        F.var_pop(outcome).alias("var_y"),
    )


def response_slope(treatment: str, outcome: str) -> Column:
    """Sample covariance of arm and outcome over the population variance of the arm."""
    return safe_divide(F.covar_samp(treatment, outcome), F.var_pop(treatment))


def smoothed_rate(n: Column, total: Column, parent: Column, min_rows: int, weight: float) -> Column:
    """A child's arm mean pulled toward its parent's, or the parent's if it is too small."""
    return F.when(n > min_rows, (total + parent * weight) / (n + weight)).otherwise(parent)


def group_effect_stats(
    df: DataFrame, key: str, treatment: str, outcome: str, binary: bool = True
) -> DataFrame:
    """Arm sums, counts and sample variances per group with the effect and its z p-value."""
    t, y = F.col(treatment), F.col(outcome)
    arms = {"t": F.when(t > 0, y), "c": F.when(t == 0, y)}
    out = df.groupBy(key).agg(
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"sum_{a}") for a, v in arms.items()],
        *[F.count(v).alias(f"num_{a}") for a, v in arms.items()],
        *[F.var_samp(v).alias(f"var_{a}") for a, v in arms.items()],
    )
    p_t = safe_divide(F.col("sum_t"), F.col("num_t"))
    p_c = safe_divide(F.col("sum_c"), F.col("num_c"))
    spread = (None, None) if binary else (F.col("var_c"), F.col("var_t"))
    p = z_p_value(p_c, F.col("num_c"), p_t, F.col("num_t"), *spread)
    return out.select("*", (p_t - p_c).alias("uplift"), p.alias("p_value"))


def score_histogram(df: DataFrame, score: str, by: str, width: float) -> DataFrame:
    """Counts per arm and fixed-width bin, bins starting at the overall minimum."""
    low = df.agg(F.min(score)).first()[0]
    place = F.floor((F.col(score) - F.lit(low)) / F.lit(width)).cast("long")
    return df.where(F.col(score).isNotNull()).groupBy(by, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def auto_bin_width(df: DataFrame, score: str) -> float:
    """The narrower of the Sturges and Freedman-Diaconis widths."""
    quart = grouped_percentiles(df, [], score, [0.25, 0.75]).first()["percentiles"]
    row = df.agg(F.count(score).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    sturges = (row["hi"] - row["lo"]) / (math.log2(row["n"]) + 1.0)
    diaconis = 2.0 * (quart[1] - quart[0]) / row["n"] ** (1.0 / 3.0)
    width = min(w for w in (sturges, diaconis) if w > 0) if sturges > 0 else 1.0
    return width


def density_grid(df: DataFrame, score: str, by: str, points: int = 200, reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid.

    Bandwidth is the sample deviation times n^(-1/5); the grid runs ``reach``
    bandwidths past the extremes. Equal scores are merged first and each merged
    row adds to every grid point, combined map-side.
    """
    rows = df.where(F.col(score).isNotNull())
    summary = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.stddev_samp(score).alias("sd"),
        F.min(score).alias("lo"), F.max(score).alias("hi"),
    ).withColumn("bw", F.col("sd") * F.pow(F.col("rows"), F.lit(-0.2)))
    summary = summary.select(
        by, "rows", "bw",
        (F.col("lo") - reach * F.col("bw")).alias("from"),
        ((F.col("hi") - F.col("lo") + 2 * reach * F.col("bw")) / (points - 1)).alias("step"),
    )
    merged = rows.groupBy(by, score).agg(F.count(F.lit(1)).alias("n"))
    # one summary row per arm; a shuffle on the arm would leave two tasks with everything
    spread = merged.join(F.broadcast(summary), by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("from") + F.col("i") * F.col("step")
    z = (x - F.col(score)) / F.col("bw")
    kernel = F.col("n") * F.exp(-0.5 * z * z)
    return spread.groupBy(by, "i").agg(
        F.max(x).alias("x"),
        (F.sum(kernel) / F.max(F.col("rows") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"),
    )


def level_distribution(df: DataFrame, group: str, level: str, missing: str = "None") -> DataFrame:
    return df.groupBy(group, F.coalesce(F.col(level), F.lit(missing)).alias(level)).agg(
        F.count(F.lit(1)).alias("n")
    )


def caliper(df: DataFrame, score: str, ratio: float, by=()) -> DataFrame:
    """Population deviation of the score times ``ratio``."""
    return df.groupBy(*by).agg((F.stddev_pop(score) * ratio).alias("caliper"))


def candidate_thresholds(
    df: DataFrame, features, shares, few: int = 10
) -> DataFrame:
    """Split candidates per numeric feature: distinct values if few, else percentiles."""
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
            for f in features
        ])).alias("r")
    ).select("r.*")
    stats = grouped_percentiles(long, ["feature"], "value", list(shares), keep=few)
    chosen = F.when(F.col("distinct_values") > few, F.col("percentiles")).otherwise(F.col("lowest"))
    return stats.select("feature", F.explode(F.array_distinct(F.array_sort(chosen))).alias("threshold"))


def daily_series(df: DataFrame, date: str, label: str, labels, values) -> DataFrame:
    """One column per label and value, a row per day."""
    wide = df.groupBy(date).pivot(label, list(labels)).agg(*[F.sum(v).alias(v) for v in values])
    return wide.orderBy(date)
