"""Group statistics, balance, distributions and panel regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tauframe.functions.stats import erfc_sql
from tauframe.functions.stats import t_p_sql
from tauframe.operators import describe, did
from tauframe.operators.describe import response_slope, smoothed_rate
from tauframe.operators.matching import match_with_replacement, pair_copies
from tauframe.operators.uplift_tree import CANDIDATE_SHARES
from tauframe.plans.catalog.fixtures import (
    DAILY,
    LEVELS,
    NUMERIC,
    PANEL,
    PS,
    RAW_UNITS,
    SPEC,
    UNITS,
    daily,
    levels,
    panel,
    propensity_units,
    raw_units,
    units,
)
from tauframe.plans.catalog.registry import q6, query, rounded, with_

FEATURES = [*NUMERIC, "y"]


def _pooled_sql(m1, v1, n1, m0, v0, n0) -> tuple[str, str]:
    sd = f"sqrt((({n1} - 1) * {v1} + ({n0} - 1) * {v0}) / ({n1} + {n0} - 2))"
    smd = f"({m1} - {m0}) / ({sd})"
    t = f"({m0} - {m1}) / (({sd}) * sqrt(1e0 / {n1} + 1e0 / {n0}))"
    return smd, t


def _moments_sql(source: str, features, keys: str = "") -> str:
    """feature, n0, m0, v0, n1, m1, v1 for every feature."""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{f}' AS feature, "
        + ", ".join(
            f"count({f}) FILTER (treatment = {a}) AS n{a}, avg({f}) FILTER (treatment = {a}) AS m{a}, "
            f"var_samp({f}) FILTER (treatment = {a}) AS v{a}" for a in (0, 1))
        + f" FROM {source} {group}"
        for f in features
    )


SMD_SQL, T_SQL = _pooled_sql("m1", "v1", "n1", "m0", "v0", "n0")


@query("arm_counts", with_(
    "SELECT treatment, count(y_num) AS y_num, count(y_bin) AS y_bin, count(price) AS price "
    "FROM raw_units GROUP BY 1", RAW_UNITS))
def arm_counts(spark, sf_dir):
    return describe.counts_by(raw_units(spark, sf_dir), "treatment", ["y_num", "y_bin", "price"])


@query("arm_means", with_("SELECT treatment, " + ", ".join(
    f"{q6(f'avg({c})')} AS {c}" for c in FEATURES) + " FROM units GROUP BY 1", UNITS))
def arm_means(spark, sf_dir):
    return rounded(describe.means_by(units(spark, sf_dir), "treatment", FEATURES), *FEATURES)


@query("group_period_means", with_(
    f"SELECT category, post, {q6('avg(rate)')} AS rate FROM panel GROUP BY 1, 2", PANEL))
def group_period_means(spark, sf_dir):
    return rounded(describe.means_by(panel(spark, sf_dir), ["category", "post"], ["rate"]), "rate")


DID_SQL = """((avg(rate) FILTER (category = 1 AND post = 1) - avg(rate) FILTER (category = 1 AND post = 0))
 - (avg(rate) FILTER (category = 0 AND post = 1) - avg(rate) FILTER (category = 0 AND post = 0)))"""


@query("did_2x2", with_(f"SELECT {q6(DID_SQL)} AS effect FROM panel", PANEL))
def did_2x2(spark, sf_dir):
    return rounded(
        describe.difference_in_differences(panel(spark, sf_dir), "category", "post", "rate"), "effect"
    )


@query("trend_table", with_(
    f"SELECT strftime(dt, '%Y%m%d') AS ds, category, {q6('avg(rate)')} AS mean_outcome FROM panel GROUP BY 1, 2",
    PANEL))
def trend_table(spark, sf_dir):
    out = did.trend_table(panel(spark, sf_dir), "dt", "category", "rate")
    return rounded(
        out.select(F.date_format("dt", "yyyyMMdd").alias("ds"), "category", "mean_outcome"), "mean_outcome"
    )


@query("compare_groups", with_(f"""
SELECT {q6('m0')} AS control_mean, {q6('m1')} AS treatment_mean, {q6(T_SQL)} AS t_stat, n0 + n1 - 2 AS dof
FROM ({_moments_sql('units', ['y'])})""", UNITS))
def compare_groups(spark, sf_dir):
    out = describe.compare_arms(units(spark, sf_dir), "treatment", "y")
    return rounded(out, "control_mean", "treatment_mean", "t_stat").drop("p_value", "significant")


@query("compare_groups_verdict", with_(f"""
SELECT control_mean, treatment_mean, t_stat, dof, {q6(t_p_sql('t_stat', 'dof'))} AS p_value,
  NOT ({t_p_sql('t_stat', 'dof')} > 0.05e0) AS significant
FROM (SELECT {q6('m0')} AS control_mean, {q6('m1')} AS treatment_mean, {q6(T_SQL)} AS t_stat, n0 + n1 - 2 AS dof
  FROM ({_moments_sql('units', ['y'])}))""", UNITS))
def compare_groups_verdict(spark, sf_dir):
    out = describe.compare_arms(units(spark, sf_dir), "treatment", "y")
    return rounded(out, "control_mean", "treatment_mean", "t_stat", "p_value")


@query("t_test", with_(
    f"SELECT feature, {q6(T_SQL)} AS t_stat, n0 + n1 - 2 AS dof FROM ({_moments_sql('units', FEATURES)})", UNITS))
def t_test(spark, sf_dir):
    return rounded(describe.t_tests(units(spark, sf_dir), "treatment", FEATURES), "t_stat").drop("p_value")


@query("t_test_p_values", with_(f"""
SELECT feature, {q6('t')} AS t_stat, dof, {q6(t_p_sql('t', 'dof'))} AS p_value
FROM (SELECT feature, {T_SQL} AS t, n0 + n1 - 2 AS dof FROM ({_moments_sql('units', FEATURES)}))""", UNITS))
def t_test_p_values(spark, sf_dir):
    return rounded(describe.t_tests(units(spark, sf_dir), "treatment", FEATURES), "t_stat", "p_value")


@query("smd", with_(f"SELECT feature, {q6(SMD_SQL)} AS smd FROM ({_moments_sql('units', FEATURES)})", UNITS))
def smd(spark, sf_dir):
    out = describe.balance_table(units(spark, sf_dir), "treatment", FEATURES)
    return rounded(out.select("feature", "smd"), "smd")


@query("balance_before", with_(
    f"SELECT feature, 'before' AS matching, {q6(SMD_SQL)} AS smd FROM ({_moments_sql('units', FEATURES)})", UNITS))
def balance_before(spark, sf_dir):
    out = describe.balance_table(units(spark, sf_dir), "treatment", FEATURES)
    return rounded(out, "smd").drop("p_value")


# First control among the ten nearest rows of each treated unit.
REPLACEMENT = PS + """,
placed AS (SELECT *, row_number() OVER (ORDER BY ps, uid) AS pos FROM ps_units),
near AS (
  SELECT a.uid, b.uid AS neighbour, b.treatment AS neighbour_arm, abs(a.ps - b.ps) AS gap,
         row_number() OVER (PARTITION BY a.uid ORDER BY abs(a.ps - b.ps), abs(a.pos - b.pos), b.pos) AS rank
  FROM placed a JOIN placed b ON b.pos BETWEEN a.pos - 10 AND a.pos + 10 WHERE a.treatment = 1),
pairs AS (
  SELECT uid, arg_min(neighbour, rank) AS matched_id, arg_min(gap, rank) AS gap
  FROM near WHERE rank <= 10 AND neighbour_arm = 0 GROUP BY 1)"""

MATCHED = REPLACEMENT + """,
sample AS (
  SELECT u.* FROM units u JOIN pairs p ON u.uid = p.uid
  UNION ALL SELECT u.* FROM units u JOIN pairs p ON u.uid = p.matched_id),
both_samples AS (
  SELECT 'before' AS matching, * FROM units UNION ALL SELECT 'after' AS matching, * FROM sample)"""


@query("balance_before_after", with_(f"""
SELECT feature, matching, {q6(f'abs({SMD_SQL})')} AS smd, {q6(t_p_sql(f'({T_SQL})', 'n0 + n1 - 2'))} AS p_value,
  n1 AS n_treatment, n0 AS n_control
FROM ({_moments_sql('both_samples', FEATURES, 'matching')})""", MATCHED))
def balance_before_after(spark, sf_dir):
    df = propensity_units(spark, sf_dir)
    pairs = match_with_replacement(df, SPEC, "ps")
    out = describe.balance_before_after(df, pair_copies(pairs, "uid"), "uid", "treatment", FEATURES)
    return rounded(out, "smd", "p_value")


@query("node_summary_root", with_(f"""
SELECT treatment, sum(yb)::double AS sum_y, count(*) AS n, {q6('var_pop(yb)')} AS var_y, {q6('avg(yb)')} AS p
FROM units GROUP BY 1""", UNITS))
def node_summary_root(spark, sf_dir):
    out = describe.arm_moments(units(spark, sf_dir), [], "treatment", "yb")
    return rounded(out.withColumn("p", F.try_divide("sum_y", "n")), "var_y", "p")


@query("node_slope", with_(
    f"SELECT {q6('covar_samp(treatment, yb) / var_pop(treatment)')} AS slope FROM units", UNITS))
def node_slope(spark, sf_dir):
    return rounded(units(spark, sf_dir).agg(response_slope("treatment", "yb").alias("slope")), "slope")


@query("node_summary_child", with_(f"""
SELECT side, c.treatment, c.n, {q6('CASE WHEN c.n > 10 THEN (c.s + p.p * 100) / (c.n + 100) ELSE p.p END')} AS p
FROM (SELECT price >= 250000 AS side, treatment, count(*) AS n, sum(yb) AS s FROM units GROUP BY 1, 2) c
JOIN (SELECT treatment, avg(yb) AS p FROM units GROUP BY 1) p ON p.treatment = c.treatment""", UNITS))
def node_summary_child(spark, sf_dir):
    df = units(spark, sf_dir).withColumn("side", F.col("price") >= 250000)
    root = describe.arm_moments(df, [], "treatment", "yb").select(
        "treatment", (F.col("sum_y") / F.col("n")).alias("parent"))
    child = describe.arm_moments(df, ["side"], "treatment", "yb")
    out = child.join(root, "treatment").select(
        "side", "treatment", "n",
        smoothed_rate(F.col("n"), F.col("sum_y"), F.col("parent"), 10, 100).alias("p"),
    )
    return rounded(out, "p")


def _group_sql(key: str, y: str, binary: bool, extra: str = "") -> str:
    p1, p0 = "(sum_t / num_t)", "(sum_c / num_c)"
    if binary:
        var = f"{p1} * (1 - {p1}) / num_t + {p0} * (1 - {p0}) / num_c"
    else:
        var = "var_t / num_t + var_c / num_c"
    z = f"(abs({p0} - {p1}) / sqrt({var}) / sqrt(2e0))"
    return f"""
SELECT {key}, {extra} sum_t, sum_c, num_t, num_c, {q6(f'{p1} - {p0}')} AS uplift, {q6(erfc_sql(z))} AS p_value
FROM (SELECT {key}, sum({y}) FILTER (treatment > 0)::double AS sum_t, sum({y}) FILTER (treatment = 0)::double AS sum_c,
             count(*) FILTER (treatment > 0) AS num_t, count(*) FILTER (treatment = 0) AS num_c,
             var_samp({y}) FILTER (treatment > 0) AS var_t, var_samp({y}) FILTER (treatment = 0) AS var_c
      FROM units GROUP BY 1)"""


@query("z_pvalue_binary", with_(_group_sql("segment", "yb", True), UNITS))
def z_pvalue_binary(spark, sf_dir):
    out = describe.group_effect_stats(units(spark, sf_dir), "segment", "treatment", "yb", True)
    return rounded(out, "uplift", "p_value").drop("var_t", "var_c")


@query("z_pvalue_continuous", with_(_group_sql("segment", "y", False), UNITS))
def z_pvalue_continuous(spark, sf_dir):
    out = describe.group_effect_stats(units(spark, sf_dir), "segment", "treatment", "y", False)
    return rounded(out, "uplift", "p_value").drop("var_t", "var_c")


@query("ate_train_test", with_(f"""
SELECT CASE WHEN uid % 5 < 4 THEN 1 ELSE 0 END AS train,
       {q6('avg(y) FILTER (treatment = 1) - avg(y) FILTER (treatment = 0)')} AS ate
FROM units GROUP BY 1""", UNITS))
def ate_train_test(spark, sf_dir):
    df = units(spark, sf_dir).withColumn("train", (F.col("uid") % 5 < 4).cast("int"))
    return rounded(describe.average_effect(df, "treatment", "y", ["train"]), "ate")


@query("leaf_arm_stats", with_(_group_sql("status", "y", False, f"{q6('var_t')} AS var_t, {q6('var_c')} AS var_c,"),
                               UNITS))
def leaf_arm_stats(spark, sf_dir):
    out = describe.group_effect_stats(units(spark, sf_dir), "status", "treatment", "y", False)
    return rounded(out, "uplift", "p_value", "var_t", "var_c")


@query("accuracy", with_(
    f"SELECT {q6('avg(CASE WHEN treatment = (ps >= 0.5e0)::int THEN 1 ELSE 0 END)')} AS accuracy FROM ps_units", PS))
def accuracy(spark, sf_dir):
    df = propensity_units(spark, sf_dir).withColumn("guess", (F.col("ps") >= 0.5).cast("int"))
    return rounded(describe.accuracy(df, "treatment", "guess"), "accuracy")


@query("distinct_levels", with_("SELECT DISTINCT active_level FROM levels", LEVELS))
def distinct_levels(spark, sf_dir):
    return describe.distinct_values(levels(spark, sf_dir), "active_level")


def _candidates_sql(source: str, features) -> str:
    shares = ", ".join(f"{s}e0" for s in CANDIDATE_SHARES)
    return " UNION ALL ".join(f"""
SELECT '{f}' AS feature, {q6('v')} AS threshold FROM (
  SELECT DISTINCT unnest(CASE WHEN count(DISTINCT {f}) > 10 THEN quantile_cont({f}::double, [{shares}])
                         ELSE list(DISTINCT {f}::double) END) AS v FROM {source})""" for f in features)


@query("candidate_thresholds", with_(_candidates_sql("units", [*NUMERIC, "y"]), UNITS))
def candidate_thresholds(spark, sf_dir):
    out = describe.candidate_thresholds(units(spark, sf_dir), [*NUMERIC, "y"], CANDIDATE_SHARES)
    return rounded(out, "threshold")


@query("score_histogram", with_("""
SELECT treatment, floor((ps - (SELECT min(ps) FROM ps_units)) / 0.04e0)::bigint AS bin, count(*) AS n
FROM ps_units GROUP BY 1, 2""", PS))
def score_histogram(spark, sf_dir):
    return describe.score_histogram(propensity_units(spark, sf_dir), "ps", "treatment", 0.04)


@query("score_histogram_auto", with_("""
SELECT treatment, floor((price - lo) / w)::bigint AS bin, count(*) AS n
FROM units, (SELECT min(price) AS lo, least((max(price) - min(price)) / (log2(count(*)) + 1),
    2 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / count(*) ** (1e0 / 3e0)) AS w FROM units)
GROUP BY 1, 2""", UNITS))
def score_histogram_auto(spark, sf_dir):
    df = units(spark, sf_dir)
    return describe.score_histogram(df, "price", "treatment", describe.auto_bin_width(df, "price"))


@query("level_distribution", with_("""
SELECT treatment, coalesce(active_level, 'None') AS active_level, count(*) AS n
FROM units JOIN levels USING (cust) GROUP BY 1, 2""", UNITS, LEVELS))
def level_distribution(spark, sf_dir):
    df = units(spark, sf_dir).join(levels(spark, sf_dir), "cust")
    return describe.level_distribution(df, "treatment", "active_level")


@query("kde_grid", with_(f"""
SELECT treatment, i, {q6('"from" + i * step')} AS x,
       {q6('sum(n * exp(-0.5e0 * (("from" + i * step - ps) / bw) * (("from" + i * step - ps) / bw))) / (max(cnt) * max(bw) * sqrt(2 * pi()))')} AS density
FROM (SELECT treatment, ps, count(*) AS n FROM ps_units GROUP BY 1, 2) r
JOIN (SELECT treatment, cnt, bw, lo - 3 * bw AS "from", (hi - lo + 6 * bw) / 49e0 AS step FROM (
  SELECT treatment, count(*) AS cnt, stddev_samp(ps) * count(*) ** (-0.2e0) AS bw, min(ps) AS lo, max(ps) AS hi
  FROM ps_units GROUP BY 1)) s USING (treatment), (SELECT unnest(range(50))::int AS i)
GROUP BY treatment, i, "from", step""", PS))
def kde_grid(spark, sf_dir):
    out = describe.density_grid(propensity_units(spark, sf_dir), "ps", "treatment", points=50)
    return rounded(out, "x", "density")


@query("arm_totals", with_("""
SELECT count(*) FILTER (treatment = 1) AS n_treatment, count(*) FILTER (treatment = 0) AS n_control,
       count(*) AS n FROM units""", UNITS))
def arm_totals(spark, sf_dir):
    return describe.arm_totals(units(spark, sf_dir), "treatment")


@query("caliper", with_(f"SELECT {q6('stddev_pop(ps) * 0.5e0')} AS caliper FROM ps_units", PS))
def caliper(spark, sf_dir):
    return rounded(describe.caliper(propensity_units(spark, sf_dir), "ps", 0.5), "caliper")


@query("caliper_by_stratum", with_(f"""
SELECT active_level, {q6('stddev_pop(ps) * 0.1e0')} AS caliper
FROM ps_units JOIN levels USING (cust) WHERE active_level IS NOT NULL GROUP BY 1""", PS, LEVELS))
def caliper_by_stratum(spark, sf_dir):
    df = propensity_units(spark, sf_dir).join(levels(spark, sf_dir), "cust").where("active_level is not null")
    return rounded(describe.caliper(df, "ps", 0.1, ["active_level"]), "caliper")


LABELS = ["click", "purchase", "signup", "view"]


@query("daily_series", with_("SELECT ds, " + ", ".join(
    f"sum({v}) FILTER (label = '{x}')::bigint AS {x}_{v}" for x in LABELS for v in ("pv", "uv"))
    + " FROM daily GROUP BY 1", DAILY))
def daily_series(spark, sf_dir):
    return describe.daily_series(daily(spark, sf_dir), "ds", "label", LABELS, ["pv", "uv"])


@query("daily_share", with_(f"""
SELECT ds, event_type, pv, {q6('pv / sum(pv) OVER (PARTITION BY ds)')} AS pv_share FROM daily""", DAILY))
def daily_share(spark, sf_dir):
    from pyspark.sql.window import Window

    df = daily(spark, sf_dir)
    total = F.sum("pv").over(Window.partitionBy("ds"))
    return rounded(df.select("ds", "event_type", "pv", (F.col("pv") / total).alias("pv_share")), "pv_share")


def _cells_sql(source: str, period: str) -> str:
    cells = {
        f"m{g}{p}": f"avg(rate) FILTER (category = {g} AND {period} = {p})" for g in (0, 1) for p in (0, 1)
    }
    inner = ", ".join(f"{e} AS {n}" for n, e in cells.items())
    terms = {
        f"{period}_x_category": "(m11 - m10) - (m01 - m00)", "category": "m10 - m00",
        period: "m01 - m00", "intercept": "m00",
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS term, {q6(e)} AS estimate FROM (SELECT {inner} FROM {source})"
        for t, e in terms.items()
    )


PLACEBO = """placebo_panel AS (
  SELECT *, CASE WHEN dt >= DATE '2024-01-08' THEN 1 ELSE 0 END AS placebo
  FROM panel WHERE dt < DATE '2024-01-16')"""


@query("did_ols", with_(_cells_sql("panel", "post"), PANEL))
def did_ols(spark, sf_dir):
    out = did.did_regression(panel(spark, sf_dir), "rate", "post", "category")
    return rounded(out.select("term", "estimate"), "estimate")


INFERENCE = ("estimate", "std_error", "t_stat", "p_value", "r2")


def _inference_sql(terms: str) -> str:
    """t, p and rounding for rows of term, estimate, std_error, r2 and dof."""
    return f"""
SELECT term, {q6('estimate')} AS estimate, {q6('std_error')} AS std_error, {q6('estimate / std_error')} AS t_stat,
  {q6(t_p_sql('estimate / std_error', 'dof'))} AS p_value, {q6('r2')} AS r2, dof FROM ({terms})"""


def _cells_inference_sql(source: str, period: str) -> str:
    """The saturated fit on two groups and two periods: each cell's mean is its fitted value."""
    cell = [(g, p) for g in (0, 1) for p in (0, 1)]
    parts = ", ".join(
        f"{f}(rate) FILTER (category = {g} AND {period} = {p}) AS {n}{g}{p}"
        for g, p in cell for f, n in (("avg", "m"), ("count", "n"), ("var_pop", "v")))
    sse = " + ".join(f"n{g}{p} * v{g}{p}" for g, p in cell)
    terms = {
        f"{period}_x_category": ("(m11 - m10) - (m01 - m00)", "1e0 / n00 + 1e0 / n01 + 1e0 / n10 + 1e0 / n11"),
        "category": ("m10 - m00", "1e0 / n00 + 1e0 / n10"), period: ("m01 - m00", "1e0 / n00 + 1e0 / n01"),
        "intercept": ("m00", "1e0 / n00")}
    return _inference_sql(" UNION ALL ".join(
        f"SELECT '{t}' AS term, {e} AS estimate, sqrt(s2 * ({w})) AS std_error, r2, dof FROM "
        f"(SELECT *, ({sse}) / (n - 4) AS s2, 1 - ({sse}) / sst AS r2, n - 4 AS dof FROM "
        f"(SELECT {parts}, count(*) AS n, count(*) * var_pop(rate) AS sst FROM {source}))" for t, (e, w) in terms.items()))


@query("did_ols_inference", with_(_cells_inference_sql("panel", "post"), PANEL))
def did_ols_inference(spark, sf_dir):
    return rounded(did.did_regression(panel(spark, sf_dir), "rate", "post", "category"), *INFERENCE)


@query("did_parallel_trend_inference", with_(_cells_inference_sql("placebo_panel", "placebo"), PANEL, PLACEBO))
def did_parallel_trend_inference(spark, sf_dir):
    out = did.parallel_trend_test(
        panel(spark, sf_dir), "rate", "dt", "category", "2024-01-16", "2024-01-08")
    return rounded(out, *INFERENCE)


@query("did_parallel_trend", with_(_cells_sql("placebo_panel", "placebo"), PANEL, PLACEBO))
def did_parallel_trend(spark, sf_dir):
    out = did.parallel_trend_test(
        panel(spark, sf_dir), "rate", "dt", "category", "2024-01-16", "2024-01-08")
    return rounded(out.select("term", "estimate"), "estimate")


def _by_date_sql(table: str, period: str) -> str:
    """Least squares with date effects on two groups, one row for each date and group.

    The groups' difference on a date is the group effect plus, in the period, the
    interaction; a date's effect is the mean level left after both.
    """
    return f"""
, gaps AS (SELECT dt, max(rate) FILTER (category = 1) AS y1, max(rate) FILTER (category = 0) AS y0,
  max({period}) AS p FROM {table} GROUP BY dt)
, effects AS (SELECT avg(y1 - y0) FILTER (p = 0) AS g, avg(y1 - y0) FILTER (p = 1) - avg(y1 - y0) FILTER (p = 0) AS d FROM gaps)
, levels AS (SELECT dt, (y0 + y1 - g - d * p) / 2 AS level FROM gaps, effects)
, base AS (SELECT min_by(level, dt) AS first, min(dt) AS day FROM levels)
SELECT '{period}_x_category' AS term, {q6('d')} AS estimate FROM effects
UNION ALL SELECT 'category', {q6('g')} FROM effects
UNION ALL SELECT 'intercept', {q6('first')} FROM base
UNION ALL SELECT '_' || strftime(dt, '%m%d'), {q6('level - first')} FROM levels, base WHERE dt > day"""


@query("did_ols_time", with_("", PANEL).rstrip() + _by_date_sql("panel", "post"))
def did_ols_time(spark, sf_dir):
    out = did.did_regression_by_date(panel(spark, sf_dir), "rate", "dt", "post", "category")
    return rounded(out.select("term", "estimate"), "estimate")


@query("did_parallel_trend_time", with_("", PANEL, PLACEBO).rstrip() + _by_date_sql("placebo_panel", "placebo"))
def did_parallel_trend_time(spark, sf_dir):
    out = did.parallel_trend_test_by_date(
        panel(spark, sf_dir), "rate", "dt", "category", "2024-01-16", "2024-01-08")
    return rounded(out.select("term", "estimate"), "estimate")


def _by_date_inference_sql(table: str, period: str) -> str:
    """Errors of the fit above: gaps and sums of a date's two rows are independent."""
    steps = f"""
, gaps AS (SELECT dt, max(rate) FILTER (category = 1) AS y1, max(rate) FILTER (category = 0) AS y0,
  max({period}) AS p FROM {table} GROUP BY dt)
, means AS (SELECT avg(y1 - y0) FILTER (p = 0) AS g, avg(y1 - y0) FILTER (p = 1) - avg(y1 - y0) FILTER (p = 0) AS d,
  count(*) AS days, count(*) FILTER (p = 0) AS t0, count(*) FILTER (p = 1) AS t1 FROM gaps)
, sizes AS (SELECT sum((y1 - y0 - g - d * p) ** 2) / 2 AS sse FROM gaps, means)
, fit AS (SELECT *, sse / (days - 2) AS s2, days - 2 AS dof,
  1 - sse / (SELECT count(*) * var_pop(rate) FROM {table}) AS r2 FROM means, sizes)
, levels AS (SELECT dt, p, (y0 + y1 - g - d * p) / 2 AS level FROM gaps, fit)
, base AS (SELECT min_by(level, dt) AS first, min(dt) AS day FROM levels)"""
    return steps + _inference_sql(f"""
SELECT '{period}_x_category' AS term, d AS estimate, sqrt(2 * s2 * (1e0 / t0 + 1e0 / t1)) AS std_error, r2, dof FROM fit
UNION ALL SELECT 'category', g, sqrt(2 * s2 / t0), r2, dof FROM fit
UNION ALL SELECT 'intercept', first, sqrt((2 * s2 + 2 * s2 / t0) / 4), r2, dof FROM fit, base
UNION ALL SELECT '_' || strftime(dt, '%m%d'), level - first, sqrt(s2 + p * s2 * (1e0 / t0 + 1e0 / t1) / 2), r2, dof
  FROM levels, fit, base WHERE dt > day""")


@query("did_time_effects_full", with_("", PANEL).rstrip() + _by_date_inference_sql("panel", "post"))
def did_time_effects_full(spark, sf_dir):
    out = did.did_regression_by_date(panel(spark, sf_dir), "rate", "dt", "post", "category")
    return rounded(out, *INFERENCE)


@query("did_parallel_trend_time_full",
       with_("", PANEL, PLACEBO).rstrip() + _by_date_inference_sql("placebo_panel", "placebo"))
def did_parallel_trend_time_full(spark, sf_dir):
    out = did.parallel_trend_test_by_date(
        panel(spark, sf_dir), "rate", "dt", "category", "2024-01-16", "2024-01-08")
    return rounded(out, *INFERENCE)
