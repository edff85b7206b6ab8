"""Rank-based evaluation and nearest-neighbour matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tauframe.operators import matching, ranking
from tauframe.operators.describe import level_distribution, score_histogram
from tauframe.plans.catalog.fixtures import (
    LEVELS,
    PS,
    SCORED,
    SPEC,
    levels,
    propensity_units,
    scored,
)
from tauframe.plans.catalog.registry import q6, query, rounded, with_
from tauframe.plans.catalog.statistics import MATCHED, REPLACEMENT
from tauframe.spec import CausalSpec

SCORES = ["s1", "s2", "s3", "s4"]


def _deciles_sql(score: str) -> str:
    return with_(f"""
SELECT d * 10 AS percentile, count(*) FILTER (treatment = 1) AS n_treatment,
       count(*) FILTER (treatment <> 1) AS n_control,
       {q6('avg(y) FILTER (treatment = 1)')} AS treatment_avg, {q6('avg(y) FILTER (treatment <> 1)')} AS control_avg,
       {q6('avg(y) FILTER (treatment = 1) - avg(y) FILTER (treatment <> 1)')} AS uplift
FROM (SELECT *, ntile(10) OVER (ORDER BY {score} DESC, uid DESC) AS d FROM scored) GROUP BY 1""", SCORED)


def _deciles(score: str):
    def run(spark, sf_dir):
        out = ranking.uplift_deciles(scored(spark, sf_dir), "uid", "treatment", "y", score)
        return rounded(out, "treatment_avg", "control_avg", "uplift")

    return run


query("uplift_deciles", _deciles_sql("s1"))(_deciles("s1"))
query("uplift_deciles_tied", _deciles_sql("s4"))(_deciles("s4"))


def _gain_cte(score: str) -> str:
    return SCORED + f""",
gains AS (
  SELECT uid, treatment, y, {score} AS score, rn - 1 AS rank,
         CASE WHEN n_t > 0 AND n_c > 0 THEN (s_t / n_t - s_c / n_c) * rn ELSE 0e0 END AS gain
  FROM (SELECT *, row_number() OVER w AS rn,
               sum((treatment = 1)::int) OVER w AS n_t, sum((treatment = 0)::int) OVER w AS n_c,
               sum(CASE WHEN treatment = 1 THEN y ELSE 0e0 END) OVER w AS s_t,
               sum(CASE WHEN treatment = 0 THEN y ELSE 0e0 END) OVER w AS s_c
        FROM scored WINDOW w AS (ORDER BY {score} DESC, uid ROWS UNBOUNDED PRECEDING))),
best AS (SELECT rank, gain, score FROM gains ORDER BY gain DESC, rank LIMIT 1)"""


@query("cumulative_gain", with_(f"SELECT uid, rank::bigint AS rank, {q6('gain')} AS gain FROM gains", _gain_cte("s1")))
def cumulative_gain(spark, sf_dir):
    out = ranking.cumulative_gain(scored(spark, sf_dir), "uid", "treatment", "y", "s1")
    return rounded(out.select("uid", "rank", "gain"), "gain")


@query("cumulative_gain_tied", with_(
    f"SELECT uid, rank::bigint AS rank, {q6('gain')} AS gain FROM gains", _gain_cte("s3")))
def cumulative_gain_tied(spark, sf_dir):
    out = ranking.cumulative_gain(scored(spark, sf_dir), "uid", "treatment", "y", "s3")
    return rounded(out.select("uid", "rank", "gain"), "gain")


@query("gain_argmax", with_(f"SELECT rank::bigint AS rank, {q6('gain')} AS gain FROM best", _gain_cte("s1")))
def gain_argmax(spark, sf_dir):
    gains = ranking.cumulative_gain(scored(spark, sf_dir), "uid", "treatment", "y", "s1")
    return rounded(ranking.best_cut(gains, "s1").select("rank", "gain"), "gain")


@query("optimal_threshold", with_(f"SELECT {q6('score')} AS threshold FROM best", _gain_cte("s1")))
def optimal_threshold(spark, sf_dir):
    gains = ranking.cumulative_gain(scored(spark, sf_dir), "uid", "treatment", "y", "s1")
    return rounded(ranking.best_cut(gains, "s1").select("threshold"), "threshold")


@query("flag_threshold", with_(
    "SELECT uid, CASE WHEN s1 >= (SELECT score FROM best) THEN 1 ELSE 0 END AS is_high_uplift FROM scored",
    _gain_cte("s1")))
def flag_threshold(spark, sf_dir):
    df = scored(spark, sf_dir)
    gains = ranking.cumulative_gain(df, "uid", "treatment", "y", "s1")
    cut = ranking.best_cut(gains, "s1").first()["threshold"]
    return ranking.flag_by_threshold(df, "s1", cut).select("uid", "is_high_uplift")


@query("flag_position", with_(
    "SELECT uid, (rank <= (SELECT rank FROM best))::int AS is_high_uplift FROM gains", _gain_cte("s1")))
def flag_position(spark, sf_dir):
    gains = ranking.cumulative_gain(scored(spark, sf_dir), "uid", "treatment", "y", "s1")
    cut = ranking.best_cut(gains, "s1").first()["rank"]
    return ranking.flag_by_rank(gains, cut).select("uid", "is_high_uplift")


@query("flag_summary", with_(f"""
SELECT (rank <= (SELECT rank FROM best))::int AS is_high_uplift, count(*) AS n, {q6('avg(score)')} AS mean_score
FROM gains GROUP BY 1""", _gain_cte("s1")))
def flag_summary(spark, sf_dir):
    gains = ranking.cumulative_gain(scored(spark, sf_dir), "uid", "treatment", "y", "s1")
    flagged = ranking.flag_by_rank(gains, ranking.best_cut(gains, "s1").first()["rank"])
    out = flagged.groupBy("is_high_uplift").agg(F.count("uid").alias("n"), F.avg("s1").alias("mean_score"))
    return rounded(out, "mean_score")


def _top_half_sql(score):
    return with_(f"""
SELECT uid, (row_number() OVER (ORDER BY {score} DESC, uid) <= (SELECT floor(count(*) * 0.5e0) FROM scored))::int
       AS is_high_uplift FROM scored""", SCORED)


@query("flag_top_half", _top_half_sql("s1"))
def flag_top_half(spark, sf_dir):
    return ranking.flag_top_share(scored(spark, sf_dir).select("uid", "s1"), "uid", "s1").drop("s1")


@query("flag_top_half_tied", _top_half_sql("s3"))
def flag_top_half_tied(spark, sf_dir):
    return ranking.flag_top_share(scored(spark, sf_dir).select("uid", "s3"), "uid", "s3").drop("s3")


LONG = " UNION ALL ".join(f"SELECT '{s}' AS model, {s} AS score, treatment, y, yb FROM scored" for s in SCORES)


def _blocks_cte(y: str, ideals: str = "") -> str:
    return SCORED + f""",
blocks AS (
  SELECT model, score, count(*) AS rows, sum((treatment = 1)::int) AS b_nt, sum((treatment <> 1)::int) AS b_nc,
         sum(CASE WHEN treatment = 1 THEN {y} ELSE 0e0 END) AS b_st,
         sum(CASE WHEN treatment <> 1 THEN {y} ELSE 0e0 END) AS b_sc
  FROM ({LONG}{ideals}) GROUP BY 1, 2),
running AS (
  SELECT *, row_number() OVER w AS block, sum(rows) OVER w AS n, sum(b_nt) OVER w AS n_t, sum(b_nc) OVER w AS n_c,
         sum(b_st) OVER w AS s_t, sum(b_sc) OVER w AS s_c
  FROM blocks WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
curves AS (
  SELECT model, block, n, rows, n_t, n_c,
         s_t - coalesce(s_c * n_t / nullif(n_c, 0), 0) AS qini,
         coalesce((s_t / nullif(n_t, 0) - s_c / nullif(n_c, 0)) * n, 0) AS gain
  FROM running),
steps AS (
  SELECT *, coalesce(lag(qini) OVER w, 0) AS qini0, coalesce(lag(gain) OVER w, 0) AS gain0
  FROM curves WINDOW w AS (PARTITION BY model ORDER BY block))"""


QINI_SQL = f"""
qini AS (
  SELECT model, {q6('sum(rows * qini0 + (rows + 1) / 2e0 * (qini - qini0)) / ((max(n) + 1) * abs(arg_max(qini, block))) - sign(arg_max(qini, block)) * 0.5e0')} AS qini
  FROM steps GROUP BY 1)"""


@query("qini_score", with_("SELECT model, qini FROM qini", _blocks_cte("y"), QINI_SQL))
def qini_score(spark, sf_dir):
    return rounded(ranking.qini_scores(scored(spark, sf_dir), "treatment", "y", SCORES), "qini")


@query("qini_curve", with_(
    f"SELECT model, block::bigint AS block, n::bigint AS n_targeted, {q6('qini')} AS value FROM curves",
    _blocks_cte("y")))
def qini_curve(spark, sf_dir):
    return rounded(ranking.qini_curve(scored(spark, sf_dir), "treatment", "y", SCORES), "value")


@query("gain_curve", with_(
    f"SELECT model, block::bigint AS block, n::bigint AS n_targeted, {q6('gain')} AS value FROM curves",
    _blocks_cte("y")))
def gain_curve(spark, sf_dir):
    return rounded(ranking.gain_curve(scored(spark, sf_dir), "treatment", "y", SCORES), "value")


@query("gain_curve_points", with_(f"""
SELECT model, block::bigint AS block, n::bigint AS n_targeted, {q6('gain')} AS value
FROM (SELECT *, max(block) OVER (PARTITION BY model) AS last FROM curves)
WHERE block * 100 // last > (block - 1) * 100 // last""", _blocks_cte("y")))
def gain_curve_points(spark, sf_dir):
    curve = ranking.gain_curve(scored(spark, sf_dir), "treatment", "y", SCORES)
    return rounded(ranking.curve_points(curve, 100), "value")


IDEALS = """
 UNION ALL SELECT 'ideal_gain', 2 * (yb = treatment)::int + CASE WHEN
     (SELECT count(*) FILTER (yb = 1 AND treatment = 0) > count(*) FILTER (yb = 0 AND treatment = 1) FROM scored)
     THEN yb ELSE treatment END, treatment, y, yb FROM scored
 UNION ALL SELECT 'ideal_qini', yb * treatment - yb * (1 - treatment), treatment, y, yb FROM scored"""


@query("auuc_auqc", with_(f"""
SELECT a.model, {q6("a.gain_excess / (SELECT gain_excess FROM areas WHERE model = 'ideal_gain')")} AS auuc,
       {q6("a.qini_excess / (SELECT qini_excess FROM areas WHERE model = 'ideal_qini')")} AS auqc
FROM areas a WHERE model NOT LIKE 'ideal%'""", _blocks_cte("yb", IDEALS), """
areas AS (
  SELECT model, sum(rows * (gain + gain0) / 2) - arg_max(gain, block) * max(n) / 2 AS gain_excess,
         sum(rows * (qini + qini0) / 2) - arg_max(qini, block) * max(n) / 2 AS qini_excess
  FROM steps GROUP BY 1)"""))
def auuc_auqc(spark, sf_dir):
    return rounded(ranking.curve_areas(scored(spark, sf_dir), "treatment", "yb", SCORES), "auuc", "auqc")


@query("top_models", with_("SELECT model, qini FROM qini ORDER BY qini DESC, model LIMIT 2",
                           _blocks_cte("y"), QINI_SQL))
def top_models(spark, sf_dir):
    scores = ranking.qini_scores(scored(spark, sf_dir), "treatment", "y", SCORES)
    return rounded(ranking.top_rows(scores, "qini", 2, "model"), "qini")


@query("top_features", with_(f"""
SELECT feature, importance FROM (
  SELECT 'price' AS feature, {q6('abs(corr(price, y))')} AS importance FROM scored
  UNION ALL SELECT 'acctbal', {q6('abs(corr(acctbal, y))')} FROM scored
  UNION ALL SELECT 'omonth', {q6('abs(corr(omonth, y))')} FROM scored)
ORDER BY importance DESC, feature LIMIT 2""", SCORED))
def top_features(spark, sf_dir):
    names = list(SPEC.covariates)
    wide = scored(spark, sf_dir).agg(*[F.abs(F.corr(c, "y")).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in names])
    long = wide.select(F.explode(pairs).alias("r")).select("r.*")
    return rounded(ranking.top_rows(long, "importance", 2, "feature"), "importance")


@query("knn_1d", with_(f"""
SELECT uid, rank::int AS rank, neighbour, neighbour_arm, {q6('gap')} AS gap FROM near WHERE rank <= 10""", REPLACEMENT))
def knn_1d(spark, sf_dir):
    return rounded(matching.neighbour_pairs(propensity_units(spark, sf_dir), SPEC, "ps", 10), "gap")


TIED = REPLACEMENT.replace("ORDER BY ps, uid", "ORDER BY ps_tied, uid").replace(
    "abs(a.ps - b.ps)", "abs(a.ps_tied - b.ps_tied)")


@query("knn_1d_tied", with_(f"""
SELECT uid, rank::int AS rank, neighbour, neighbour_arm, {q6('gap')} AS gap FROM near WHERE rank <= 10""", TIED))
def knn_1d_tied(spark, sf_dir):
    return rounded(matching.neighbour_pairs(propensity_units(spark, sf_dir), SPEC, "ps_tied", 10), "gap")


@query("match_replacement", with_(f"SELECT uid, matched_id, {q6('gap')} AS gap FROM pairs", REPLACEMENT))
def match_replacement(spark, sf_dir):
    return rounded(matching.match_with_replacement(propensity_units(spark, sf_dir), SPEC, "ps"), "gap")


@query("match_caliper", with_(f"""
SELECT uid, matched_id, {q6('gap')} AS gap FROM pairs
WHERE gap <= (SELECT stddev_pop(ps) * 1e-4 FROM ps_units)""", REPLACEMENT))
def match_caliper(spark, sf_dir):
    out = matching.match_with_replacement(
        propensity_units(spark, sf_dir), SPEC, "ps", ratio=1e-4, enforce_caliper=True)
    return rounded(out, "gap")


@query("match_greedy")
def match_greedy(spark, sf_dir):
    return matching.match_without_replacement(propensity_units(spark, sf_dir), SPEC, "ps")


@query("match_greedy_tied")
def match_greedy_tied(spark, sf_dir):
    return matching.match_without_replacement(propensity_units(spark, sf_dir), SPEC, "ps_tied")


STRATIFIED = CausalSpec("uid", "treatment", "y", SPEC.covariates, stratum="active_level")


@query("match_stratified")
def match_stratified(spark, sf_dir):
    df = propensity_units(spark, sf_dir).join(levels(spark, sf_dir), "cust")
    return matching.match_by_stratum(df, STRATIFIED, "ps")


@query("attach_match", with_(
    "SELECT u.uid, u.treatment, coalesce(p.matched_id, -1) AS matched_id FROM ps_units u LEFT JOIN pairs p USING (uid)", REPLACEMENT))
def attach_match(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = matching.match_with_replacement(df, SPEC, "ps")
    return matching.attach_match(df.select("uid", "treatment"), pairs, "uid").na.fill({"matched_id": -1})


@query("matched_pairs", with_(
    "SELECT uid, price, omonth, matched_id AS matched_uid FROM ps_units JOIN pairs USING (uid)", REPLACEMENT))
def matched_pairs(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = matching.match_with_replacement(df, SPEC, "ps")
    return matching.pair_table(df.select("uid", "price", "omonth"), pairs, "uid")


@query("pair_table", with_("""
SELECT uid, price, acctbal, omonth::bigint AS omonth, segment, matched_id AS matched_uid
FROM ps_units JOIN pairs USING (uid)""", REPLACEMENT))
def pair_table(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = matching.match_with_replacement(df, SPEC, "ps")
    slim = df.select("uid", "price", "acctbal", "omonth", "segment")
    return matching.pair_table(slim, pairs, "uid", {"omonth": "bigint"})


@query("matched_sample", with_("SELECT uid, treatment, count(*) AS copies FROM sample GROUP BY 1, 2", MATCHED))
def matched_sample(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = matching.match_with_replacement(df, SPEC, "ps")
    sample = matching.matched_sample(df.select("uid", "treatment"), pairs, "uid")
    return sample.groupBy("uid", "treatment").agg(F.count(F.lit(1)).alias("copies"))


@query("level_semi_join", with_(
    "SELECT uid, active_level FROM units JOIN levels USING (cust) WHERE uid IN (SELECT matched_id FROM pairs)",
    REPLACEMENT, LEVELS))
def level_semi_join(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = matching.match_with_replacement(df, SPEC, "ps")
    level = df.select("uid", "cust").join(levels(spark, sf_dir), "cust").select("uid", "active_level")
    return matching.semi_join(level, pairs.select(F.col("matched_id").alias("uid")), "uid")


@query("eligible_strata", with_("""
SELECT active_level, count(*) FILTER (treatment = 1) AS n_treatment, count(*) FILTER (treatment = 0) AS n_control
FROM ps_units JOIN levels USING (cust) WHERE active_level IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (treatment = 1) > 0 AND count(*) FILTER (treatment = 0) > 0""", PS, LEVELS))
def eligible_strata(spark, sf_dir):
    df = propensity_units(spark, sf_dir).join(levels(spark, sf_dir), "cust")
    return matching.eligible_strata(df, "treatment", "active_level")


@query("matched_level_distribution", with_("""
SELECT grp, coalesce(active_level, 'None') AS active_level, count(*) AS n FROM (
  SELECT 'treatment' AS grp, cust FROM units WHERE uid IN (SELECT uid FROM pairs)
  UNION ALL SELECT 'control', cust FROM units WHERE uid IN (SELECT matched_id FROM pairs)
) JOIN levels USING (cust) GROUP BY 1, 2""", REPLACEMENT, LEVELS))
def matched_level_distribution(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = matching.match_with_replacement(df, SPEC, "ps")
    level = df.select("uid", "cust").join(levels(spark, sf_dir), "cust")
    treated = matching.semi_join(level, pairs, "uid").withColumn("grp", F.lit("treatment"))
    control = matching.semi_join(level, pairs.select(F.col("matched_id").alias("uid")), "uid")
    both = treated.unionByName(control.withColumn("grp", F.lit("control")))
    return level_distribution(both, "grp", "active_level")


@query("matched_histogram", with_("""
SELECT treatment, floor((ps - min_ps) / 0.04e0)::bigint AS bin, count(*) AS n
FROM (SELECT p.*, min(ps) OVER () AS min_ps FROM sample s JOIN ps_units p USING (uid)) GROUP BY 1, 2""", MATCHED))
def matched_histogram(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = matching.match_with_replacement(df, SPEC, "ps")
    return score_histogram(matching.matched_sample(df, pairs, "uid"), "ps", "treatment", 0.04)
