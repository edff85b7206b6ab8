"""Rank-based evaluation of scores: deciles, cumulative gain, Qini, areas, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.functions.stats import safe_divide
from tauframe.operators.ordered import running_totals


def _descending(score: str, id_col: str, id_descending: bool) -> list[Column]:
    return [F.desc(score), F.desc(id_col) if id_descending else F.asc(id_col)]


def _within(df: DataFrame, id_col: str, score: str, cuts: list[int], id_descending: bool) -> list[Column]:
    """For each cut k a condition for the first k rows by falling score, ties by id.

    Scores are counted first; only rows that share the score a cut falls into are put in
    order. No more than two figures for each cut reach the driver, and the conditions
    need no shuffle of the rows they are applied to.
    """
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    blocks = running_totals(counts, [F.desc(score)], {"_through": F.col("_n")})
    before = F.col("_through") - F.col("_n")
    hit = [(before < k) & (k <= F.col("_through")) for k in cuts]
    found = blocks.where(reduce(lambda a, b: a | b, hit)).select(
        score, before.alias("before"), F.col("_through").alias("through")).collect()
    at = {k: next(r for r in found if r["before"] < k <= r["through"]) for k in cuts}
    same = lambda r: F.col(score).eqNullSafe(F.lit(r[score]))
    torn = [r for r in found if any(r["before"] < k < r["through"] for k in cuts)]
    last: dict[int, object] = {}
    if torn:
        group = reduce(lambda c, ir: c.when(same(ir[1]), ir[0]), enumerate(torn[1:], 1), F.when(same(torn[0]), 0))
        tied = df.select(id_col, group.alias("_g")).where("_g is not null")
        order = F.desc(id_col) if id_descending else F.asc(id_col)
        placed = running_totals(tied, [order], by=["_g"])
        wanted = {(torn.index(at[k]), k - at[k]["before"]): k for k in cuts if k < at[k]["through"]}
        pick = reduce(lambda a, b: a | b, [(F.col("_g") == g) & (F.col("pos") == m) for g, m in wanted])
        for r in placed.where(pick).collect():
            last[wanted[r["_g"], r["pos"]]] = r[id_col]
    out = []
    for k in cuts:
        row = at[k]
        above = F.col(score).isNotNull() if row[score] is None else F.coalesce(F.col(score) > F.lit(row[score]), F.lit(False))
        tied = same(row)
        if k in last:
            tied = tied & (F.col(id_col) >= F.lit(last[k]) if id_descending else F.col(id_col) <= F.lit(last[k]))
        out.append(above | tied)
    return out


def uplift_deciles(
    df: DataFrame, id_col: str, treatment: str, outcome: str, score: str, bins: int = 10
) -> DataFrame:
    """Arm sizes and means per score bin, best bin first.

    Bins are as even as possible with the larger ones first. Equal scores are
    ordered by descending id, which is a reversed stable ascending sort.
    """
    slim = df.select(id_col, treatment, outcome, score)
    small, larger = divmod(slim.count(), bins)
    ends = [i * small + min(i, larger) for i in range(1, bins)]
    cuts = sorted({e for e in ends if e})
    inside = dict(zip(cuts, _within(slim, id_col, score, cuts, True))) if cuts else {}
    place = sum((F.when(inside[e], 0).otherwise(1) for e in ends if e), F.lit(sum(not e for e in ends)))
    t, y = F.col(treatment), F.col(outcome)
    out = slim.groupBy(((place + 1) * 100 / bins).cast("long").alias("percentile")).agg(
        F.count_if(t == 1).alias("n_treatment"),
        F.count_if(t != 1).alias("n_control"),
        F.avg(F.when(t == 1, y)).alias("treatment_avg"),
        F.avg(F.when(t != 1, y)).alias("control_avg"),
    )
    return out.withColumn("uplift", F.col("treatment_avg") - F.col("control_avg"))


def cumulative_gain(
    df: DataFrame, id_col: str, treatment: str, outcome: str, score: str, keep=()
) -> DataFrame:
    """Add the 0-based rank by falling score and the gain of targeting up to it.

    The gain is the difference of the arm means among the rows so far times
    their number, and 0 until both arms have appeared.
    """
    t, y = F.col(treatment), F.col(outcome).cast("double")
    slim = df.select(*dict.fromkeys([id_col, treatment, outcome, score, *keep]))
    run = running_totals(
        slim,
        _descending(score, id_col, False),
        {
            "n_t": (t == 1).cast("long"),
            "n_c": (t == 0).cast("long"),
            "s_t": F.when(t == 1, y).otherwise(0.0),
            "s_c": F.when(t == 0, y).otherwise(0.0),
        },
    )
    gain = (safe_divide(F.col("s_t"), F.col("n_t")) - safe_divide(F.col("s_c"), F.col("n_c"))) * F.col("pos")
    return run.select(
        *slim.columns, (F.col("pos") - 1).alias("rank"), F.coalesce(gain, F.lit(0.0)).alias("gain")
    )


def best_cut(gains: DataFrame, score: str) -> DataFrame:
    """The first rank with the largest gain, that gain and the score there."""
    best = gains.agg(F.min(F.struct((-F.col("gain")).alias("loss"), "rank", score)).alias("b"))
    return best.select(
        F.col("b.rank").alias("rank"), (-F.col("b.loss")).alias("gain"),
        F.col(f"b.{score}").alias("threshold"),
    )


def flag_by_threshold(df: DataFrame, score: str, threshold: float, name: str = "is_high_uplift"):
    return df.withColumn(name, F.when(F.col(score) >= threshold, 1).otherwise(0))


def flag_by_rank(gains: DataFrame, rank: int, name: str = "is_high_uplift") -> DataFrame:
    return gains.withColumn(name, (F.col("rank") <= rank).cast("int"))


def flag_top_share(
    df: DataFrame, id_col: str, score: str, share: float = 0.5, name: str = "is_high_uplift"
) -> DataFrame:
    """1 for the first ``int(n * share)`` rows by falling score, ties by id."""
    cut = int(df.count() * share)
    if not cut:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, _within(df.select(id_col, score), id_col, score, [cut], False)[0].cast("int"))


def score_blocks(df: DataFrame, treatment: str, outcome: str, scores) -> DataFrame:
    """Running arm totals after each distinct score of each model, best score first.

    Rows with equal scores form one block, merged map-side before any sorting:
    a stepwise model shrinks to a few blocks and no tie can overload a task.
    """
    t, y = F.col(treatment), F.col(outcome).cast("double")
    long = df.select(
        t.alias("_t"), y.alias("_y"),
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores
        ])).alias("r"),
    ).select("_t", "_y", "r.*")
    blocks = long.where(F.col("score").isNotNull()).groupBy("model", "score").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_t") == 1).alias("b_nt"),
        F.count_if(F.col("_t") != 1).alias("b_nc"),
        F.coalesce(F.sum(F.when(F.col("_t") == 1, F.col("_y"))), F.lit(0.0)).alias("b_st"),
        F.coalesce(F.sum(F.when(F.col("_t") != 1, F.col("_y"))), F.lit(0.0)).alias("b_sc"),
    )
    run = running_totals(
        blocks,
        [F.desc("score")],
        {
            "n": F.col("rows"), "n_t": F.col("b_nt"), "n_c": F.col("b_nc"),
            "s_t": F.col("b_st"), "s_c": F.col("b_sc"),
        },
        by=["model"],
        position="block",
    )
    return run


def _qini(s_t, n_t, s_c, n_c) -> Column:
    # extra treated responses over what the controls' rate would have given
    return s_t - F.coalesce(safe_divide(s_c * n_t, n_c), F.lit(0.0))


def _gain(s_t, n_t, s_c, n_c, n) -> Column:
    lift = safe_divide(s_t, n_t) - safe_divide(s_c, n_c)
    return F.coalesce(lift * n, F.lit(0.0))


def _curve(df, treatment, outcome, scores, kind: str) -> DataFrame:
    """Curve values at the start and end of every block."""
    blocks = score_blocks(df, treatment, outcome, scores)
    now = [F.col(c) for c in ("s_t", "n_t", "s_c", "n_c", "n")]
    own = [F.col(c) for c in ("b_st", "b_nt", "b_sc", "b_nc", "rows")]
    before = [a - b for a, b in zip(now, own)]
    if kind == "qini":
        value, start = _qini(*now[:4]), _qini(*before[:4])
    else:
        value, start = _gain(*now), _gain(*before)
    return blocks.select(
        "model", "block", "score", "rows", F.col("n").alias("n_targeted"),
        "n_t", "n_c", "s_t", "s_c", value.alias("value"), start.alias("start"),
    )


def qini_curve(df: DataFrame, treatment: str, outcome: str, scores) -> DataFrame:
    """Incremental treated responses against the number targeted, per model."""
    return _curve(df, treatment, outcome, scores, "qini").select("model", "block", "n_targeted", "value")


def gain_curve(df: DataFrame, treatment: str, outcome: str, scores) -> DataFrame:
    """Difference of arm means times the number targeted, per model."""
    return _curve(df, treatment, outcome, scores, "gain").select("model", "block", "n_targeted", "value")


def curve_points(curve: DataFrame, points: int) -> DataFrame:
    """At most ``points`` evenly spaced blocks per model, the last one included."""
    sizes = curve.groupBy("model").agg(F.max("block").alias("last"))
    joined = curve.join(F.broadcast(sizes), "model")  # one row per model
    at = F.floor(F.col("block") * points / F.col("last"))
    was = F.floor((F.col("block") - 1) * points / F.col("last"))
    return joined.where(at > was).drop("last")


def qini_scores(df: DataFrame, treatment: str, outcome: str, scores) -> DataFrame:
    """Mean height of the normalised Qini curve above the straight line, per model.

    The curve has a point at zero and one per row; inside a block of equal
    scores it is linear, the expectation over the orders of the tied rows. It is
    divided by the absolute final value. Null when an arm is empty or the final
    value is zero.
    """
    curve = _curve(df, treatment, outcome, scores, "qini")
    m = F.col("rows").cast("double")
    block_sum = m * F.col("start") + (m + 1) / 2 * (F.col("value") - F.col("start"))
    last = F.max_by(F.struct("value", "n_targeted", "n_t", "n_c"), "block")
    out = curve.groupBy("model").agg(F.sum(block_sum).alias("total"), last.alias("l"))
    final = F.col("l.value")
    n = F.col("l.n_targeted").cast("double")
    usable = (F.col("l.n_t") > 0) & (F.col("l.n_c") > 0)
    mean_curve = safe_divide(F.col("total"), (n + 1) * F.abs(final))
    mean_line = F.signum(final) * 0.5
    return out.select("model", F.when(usable, mean_curve - mean_line).alias("qini"))


def curve_areas(df: DataFrame, treatment: str, outcome: str, scores) -> DataFrame:
    """Areas between curve and diagonal relative to the best possible curve.

    ``auuc`` uses the gain curve and ``auqc`` the Qini curve, both through the
    ends of the blocks of equal scores. Outcomes are expected in {0, 1}. The
    best gain curve puts rows whose outcome equals their arm first, the best
    Qini curve treated responders first and control responders last.
    """
    t, y = F.col(treatment), F.col(outcome)
    # Which of the first two is the best gain order depends on two counts of the last block.
    ideals = {
        "_ideal_y": 2 * (y == t).cast("double") + y, "_ideal_t": 2 * (y == t).cast("double") + t,
        "_ideal_qini": y * t - y * (1 - t),
    }
    ranked = df.select(treatment, outcome, *scores, *[v.cast("double").alias(k) for k, v in ideals.items()])
    blocks = score_blocks(ranked, treatment, outcome, [*scores, *ideals])
    now = [F.col(c) for c in ("s_t", "n_t", "s_c", "n_c", "n")]
    before = [a - F.col(b) for a, b in zip(now, ("b_st", "b_nt", "b_sc", "b_nc", "rows"))]
    blocks = blocks.withColumns({
        "gain": _gain(*now), "gain_before": _gain(*before),
        "qini": _qini(*now[:4]), "qini_before": _qini(*before[:4])})
    trapezoid = lambda k: F.sum(F.col("rows") * (F.col(k) + F.col(f"{k}_before")) / 2)
    areas = blocks.groupBy("model").agg(
        trapezoid("gain").alias("a_gain"), trapezoid("qini").alias("a_qini"),
        F.max_by(F.struct("gain", "qini", "n", "n_t", "s_t", "s_c"), "block").alias("l"))
    excess = areas.select(
        "model", (F.col("l.s_c") > F.col("l.n_t") - F.col("l.s_t")).alias("by_outcome"),
        *[(F.col(f"a_{k}") - F.col(f"l.{k}") * F.col("l.n") / 2).alias(k) for k in ("gain", "qini")])
    # One row for each model.
    every = Window.partitionBy()
    best = F.when(F.col("by_outcome"), F.lit("_ideal_y")).otherwise(F.lit("_ideal_t"))
    tops = excess.select(
        "*", F.max(F.when(F.col("model") == best, F.col("gain"))).over(every).alias("top_gain"),
        F.max(F.when(F.col("model") == "_ideal_qini", F.col("qini"))).over(every).alias("top_qini"))
    return tops.where(~F.col("model").isin(list(ideals))).select(
        "model", safe_divide(F.col("gain"), F.col("top_gain")).alias("auuc"),
        safe_divide(F.col("qini"), F.col("top_qini")).alias("auqc"))


def top_rows(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The ``n`` largest by ``value``, ties by name; nulls last."""
    return df.orderBy(F.desc_nulls_last(value), F.asc(tie)).limit(n)


def leaf_values(df: DataFrame, leaf: str, prediction: str) -> DataFrame:
    """Distinct leaf prediction and its row count."""
    return df.groupBy(leaf).agg(F.first(prediction).alias("value"), F.count(F.lit(1)).alias("n"))
