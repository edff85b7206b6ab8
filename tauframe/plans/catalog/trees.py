"""Uplift trees, causal trees and forests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tauframe.functions.stats import erfc_sql
from tauframe.operators import causal_forest as cf
from tauframe.operators import uplift_tree as ut
from tauframe.operators.tree_tables import LESS, TreeNode, TreeTables, node_shares
from tauframe.plans.catalog.fixtures import MULTI, NUMERIC, UNITS, multi_arm, units
from tauframe.plans.catalog.registry import q6, query, r6, rounded, with_
from tauframe.plans.catalog.statistics import _candidates_sql

MIN_LEAF, MIN_ARM, REG = 150, 10, 100


def _kl(p: str, q: str) -> str:
    q = f"greatest(1e-6, least(1 - 1e-6, {q}))"
    return (f"(CASE WHEN {p} = 0 THEN -ln(1 - {q}) WHEN {p} = 1 THEN -ln({q}) "
            f"ELSE {p} * ln({p} / {q}) + (1 - {p}) * ln((1 - {p}) / (1 - {q})) END)")


def _h(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN -{p} * ln({p}) ELSE 0 END)"


def _score_sql(criterion: str, side: str, arms: range) -> str:
    """Node score from columns p_<side><arm> and slope_<side>."""
    p = [f"p_{side}{k}" for k in arms]
    if criterion == "KL":
        return " + ".join(_kl(t, p[0]) for t in p[1:])
    if criterion == "ED":
        return " + ".join(f"2 * ({t} - {p[0]}) ** 2" for t in p[1:])
    if criterion == "Chi":
        return " + ".join(
            f"(({t} - {p[0]}) ** 2 / greatest(1e-6, {p[0]}) + ({t} - {p[0]}) ** 2 / greatest(1e-6, 1 - {p[0]}))"
            for t in p[1:])
    if criterion == "DDP":
        return " + ".join(f"({t} - {p[0]})" for t in p[1:])
    if criterion == "CTS":
        return f"-greatest({', '.join(p)})"
    return f"slope_{side}"


def _norm_sql(arms: range) -> str:
    n_t = "(" + " + ".join(f"n_a{k}" for k in arms[1:]) + ")"
    l_t = "(" + " + ".join(f"n_l{k}" for k in arms[1:]) + ")"
    share_t, share_c = f"({l_t} / ({n_t} + 0.1e0))", "(n_l0 / (n_a0 + 0.1e0))"
    every = f"({n_t} + n_a0)"
    out = f"0.9e0 * ({_h(f'({n_t} / {every})')} + {_h(f'(n_a0 / {every})')}) * {_kl(share_t, share_c)}"
    for k in arms[1:]:
        share, pair = f"(n_l{k} / (n_a{k} + 0.1e0))", f"(n_a{k} + n_a0)"
        out += (f" + 0.1e0 * ({_h(f'(n_a{k} / {pair})')} + {_h(f'(n_a0 / {pair})')}) * {_kl(share_c, share)}"
                f" + n_a{k} / {every} * {_h(share)}")
    return f"({out} + n_a0 / {every} * {_h(share_c)} + 0.5e0)"


def _root_split_sql(criterion: str, source: str, arm: str, arms: range, fixture: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f}::double AS x, {arm} AS t, yb FROM {source}" for f in NUMERIC)
    cond = {"l": "x >= v", "r": "NOT (x >= v)", "a": "true"}
    counts = ", ".join(
        f"count(*) FILTER ({c} AND t = {k})::double AS n_{s}{k}, coalesce(sum(yb) FILTER ({c} AND t = {k}), 0) AS s_{s}{k}"
        for s, c in cond.items() for k in arms)
    slopes = ", ".join(
        f"covar_samp(t, yb) FILTER ({c}) / nullif(var_pop(t) FILTER ({c}), 0) AS slope_{s}" for s, c in cond.items())
    rates = ", ".join(
        [f"s_a{k} / n_a{k} AS p_a{k}" for k in arms]
        + [f"CASE WHEN n_{s}{k} > {MIN_ARM} THEN (s_{s}{k} + s_a{k} / n_a{k} * {REG}) / (n_{s}{k} + {REG}) "
           f"ELSE s_a{k} / n_a{k} END AS p_{s}{k}" for s in "lr" for k in arms])
    n_l, n_r = ("(" + " + ".join(f"n_{s}{k}" for k in arms) + ")" for s in "lr")
    left, right, here = (f"({_score_sql(criterion, s, arms)})" for s in "lra")
    w = f"({n_l} / ({n_l} + {n_r}))"
    gain = {
        "CTS": f"{here} - {w} * {left} - (1 - {w}) * {right}",
        "DDP": f"abs({left} - {right})",
        "CAPE": f"{n_l} * {n_r} / (({n_l} + {n_r}) ** 2) * ({left} - {right}) ** 2",
    }.get(criterion, f"({w} * {left} + (1 - {w}) * {right} - {here}) / {_norm_sql(arms)}")
    valid = " AND ".join([f"{n_l} > {MIN_LEAF}", f"{n_r} > {MIN_LEAF}"]
                         + [f"n_{s}{k} >= {MIN_ARM}" for s in "lr" for k in arms])
    cands = _candidates_sql(source, NUMERIC).replace(q6("v"), "v")
    return with_(f"""
SELECT feature, {q6('v')} AS threshold, {q6(gain)} AS gain, {n_l}::bigint AS n_left, {n_r}::bigint AS n_right
FROM (SELECT *, {rates} FROM sides) WHERE {valid}""", fixture, f"long AS ({long})", f"cands AS ({cands})", f"""
sides AS (SELECT c.feature, c.threshold AS v, {counts}, {slopes}
          FROM cands c JOIN long USING (feature) GROUP BY 1, 2)""")


def _params(criterion: str, **changes) -> ut.UpliftTreeParams:
    return ut.UpliftTreeParams(
        criterion=criterion, min_samples_leaf=MIN_LEAF, min_samples_treatment=MIN_ARM, n_reg=REG,
        max_depth=4, **changes)


def _root_split(criterion: str):
    def run(spark, sf_dir):
        out = ut.root_splits(units(spark, sf_dir), "treatment", "yb", NUMERIC, _params(criterion))
        return rounded(out, "threshold", "gain").withColumns(
            {c: F.col(c).cast("long") for c in ("n_left", "n_right")})

    return run


for _c in ("KL", "ED", "Chi", "DDP", "CTS", "CAPE"):
    query(f"root_split_{_c.lower()}", _root_split_sql(_c, "units", "treatment", range(2), UNITS))(_root_split(_c))


def _root_split_multi(criterion: str):
    def run(spark, sf_dir):
        out = ut.root_splits(multi_arm(spark, sf_dir), "arm", "yb", NUMERIC, _params(criterion))
        return rounded(out, "threshold", "gain").withColumns(
            {c: F.col(c).cast("long") for c in ("n_left", "n_right")})

    return run


for _c in ("KL", "CTS", "CAPE"):
    query(f"root_split_multi_{_c.lower()}", _root_split_sql(_c, "multi", "arm::int", range(5), MULTI))(
        _root_split_multi(_c))


FEATURES = [*NUMERIC, "segment", "status"]


def _fit(spark, sf_dir, **changes):
    return ut.uplift_tree(
        units(spark, sf_dir), "uid", "treatment", "yb", FEATURES,
        ut.UpliftTreeParams(max_depth=4, **changes))


@query("uplift_tree_nodes")
def uplift_tree_nodes(spark, sf_dir):
    return _fit(spark, sf_dir)[0].nodes_frame(spark)


@query("uplift_tree_leaves")
def uplift_tree_leaves(spark, sf_dir):
    return _fit(spark, sf_dir, criterion="ED")[1]


@query("uplift_tree_importance")
def uplift_tree_importance(spark, sf_dir):
    return _fit(spark, sf_dir, criterion="Chi")[0].importance_frame(spark)


@query("uplift_tree_honest")
def uplift_tree_honest(spark, sf_dir):
    return ut.uplift_tree(
        units(spark, sf_dir), "uid", "treatment", "yb", NUMERIC,
        ut.UpliftTreeParams(max_depth=3), honest=True)[1]


@query("uplift_tree_multi_arm")
def uplift_tree_multi_arm(spark, sf_dir):
    report = ut.uplift_tree(
        multi_arm(spark, sf_dir), "uid", "arm", "yb", NUMERIC,
        ut.UpliftTreeParams(max_depth=3, criterion="CTS"))[1]
    text = ("p_value", "uplift_train", "uplift_test", "num_t_test", "sum_t_test")
    return report.withColumns({c: ut.display_list(c, None if c.startswith("num") else 4) for c in text})


@query("uplift_tree_validated")
def uplift_tree_validated(spark, sf_dir):
    df = units(spark, sf_dir)
    grow, check = df.where("uid % 3 < 2"), df.where("uid % 3 = 2")
    model = ut.fit_uplift_tree(grow, "treatment", "yb", NUMERIC, _params("DDP"), validation=check)
    return model.nodes_frame(spark)


@query("uplift_tree_random_features")
def uplift_tree_random_features(spark, sf_dir):
    model = ut.fit_uplift_tree(
        units(spark, sf_dir), "treatment", "yb", FEATURES, _params("ED", max_features=2, seed=5))
    return model.nodes_frame(spark)


# A fixed tree: dear orders are split by month, the others are a leaf.
SPLITS = {0: ("price", 250000.0, 1, 2), 1: ("omonth", 7.0, 3, 4)}
NODE_CASES = {
    0: "true", 1: "price >= 250000", 2: "NOT price >= 250000",
    3: "price >= 250000 AND omonth >= 7", 4: "price >= 250000 AND NOT omonth >= 7",
}
PATHS = {
    2: "price < 250000.0", 3: "price >= 250000.0 and omonth >= 7.0",
    4: "price >= 250000.0 and omonth < 7.0",
}


def _nodes_sql(columns: str, nodes=NODE_CASES, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS node_id, count(*) FILTER (treatment = 1) AS n1, count(*) FILTER (treatment = 0) AS n0, "
        f"coalesce(sum(yb) FILTER (treatment = 1), 0) AS s1, coalesce(sum(yb) FILTER (treatment = 0), 0) AS s0 "
        f"FROM units WHERE ({c}) AND ({where})" for i, c in nodes.items()) if columns == "*" else (
        f"SELECT {columns} FROM ({_nodes_sql('*', nodes, where)})")


@query("fill_fixed_tree", with_(_nodes_sql(
    "node_id, n1 + n0 AS samples_test, n1 AS num_t_test, n0 AS num_c_test, s1 AS sum_t_test, s0 AS sum_c_test, "
    f"{q6('round(s1 / n1 - s0 / n0, 4)')} AS uplift_test"), UNITS))
def fill_fixed_tree(spark, sf_dir):
    model = ut.fixed_tree(NUMERIC, SPLITS)
    out = model.fill(units(spark, sf_dir), "treatment", "yb")
    return out.select(
        "node_id", "samples_test", F.col("num_t_test")[0].alias("num_t_test"), "num_c_test",
        F.col("sum_t_test")[0].alias("sum_t_test"), "sum_c_test",
        r6(F.col("uplift_test")[0]).alias("uplift_test"),
    )


@query("leaf_table_fixed_tree", with_(
    "SELECT CASE node_id " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in PATHS.items())
    + f" END AS path, num_t, num_c, sum_t, sum_c, uplift, p_value FROM ({_nodes_sql('node_id, n1 AS num_t, n0 AS num_c, s1 AS sum_t, s0 AS sum_c, ' + q6('s1 / n1 - s0 / n0') + ' AS uplift, ' + q6(erfc_sql('(abs(s1 / n1 - s0 / n0) / sqrt((s1 / n1) * (1 - s1 / n1) / n1 + (s0 / n0) * (1 - s0 / n0) / n0) / sqrt(2e0))')) + ' AS p_value', {i: NODE_CASES[i] for i in PATHS})})",
    UNITS))
def leaf_table_fixed_tree(spark, sf_dir):
    from tauframe.operators.describe import group_effect_stats

    model = ut.fixed_tree(NUMERIC, SPLITS)
    stats = group_effect_stats(model.route(units(spark, sf_dir)), "leaf_id", "treatment", "yb")
    leaves = model.structure_frame(spark).select(F.col("node_id").alias("leaf_id"), "path")
    out = F.broadcast(leaves).join(stats, "leaf_id").select(
        "path", "num_t", "num_c", "sum_t", "sum_c", "uplift", "p_value")
    return rounded(out, "uplift", "p_value")


@query("node_rollup_fixed_tree", with_(f"""
SELECT node_id, n1 AS num_t, n0 AS num_c, {q6('n1 / max(n1) OVER ()')} AS share_t,
       {q6('n0 / max(n0) OVER ()')} AS share_c, {q6('(n1 + n0) / max(n1 + n0) OVER ()')} AS share,
       {q6('s1 / n1 - s0 / n0')} AS uplift
FROM ({_nodes_sql('*')})""", UNITS))
def node_rollup_fixed_tree(spark, sf_dir):
    model = ut.fixed_tree(NUMERIC, SPLITS)
    moments = model.node_moments(units(spark, sf_dir), F.col("treatment"), "yb", 2)
    return rounded(node_shares(moments), "share_t", "share_c", "share", "uplift")


node_shares_query = query("node_shares", with_(
    _nodes_sql(f"node_id, {q6('n1 / max(n1) OVER ()')} AS share_t, {q6('n0 / max(n0) OVER ()')} AS share_c"), UNITS))


@node_shares_query
def node_shares_fixed(spark, sf_dir):
    return node_rollup_fixed_tree(spark, sf_dir).select("node_id", "share_t", "share_c")


@query("leaf_value_distribution", with_("""
SELECT CASE WHEN NOT price >= 250000 THEN 2 WHEN omonth >= 7 THEN 3 ELSE 4 END AS leaf_id,
       CASE WHEN NOT price >= 250000 THEN 0.25e0 WHEN omonth >= 7 THEN -0.5e0 ELSE 1e0 END AS value, count(*) AS n
FROM units GROUP BY 1, 2""", UNITS))
def leaf_value_distribution(spark, sf_dir):
    from tauframe.operators.ranking import leaf_values
    from tauframe.operators.tree_tables import node_values

    model = ut.fixed_tree(NUMERIC, SPLITS)
    for node, value in ((2, 0.25), (3, -0.5), (4, 1.0)):
        model.nodes[node].value = value
    routed = model.route(units(spark, sf_dir))
    return leaf_values(
        routed.withColumn("pred", F.get(node_values(model), F.col("leaf_id"))), "leaf_id", "pred")


def fixed_causal_tree() -> TreeTables:
    nodes = [
        TreeNode(0, feature=0, threshold=250000.0, op=LESS, left=1, right=2),
        TreeNode(1, parent=0, depth=2, feature=2, threshold=6.5, op=LESS, left=3, right=4),
        TreeNode(2, parent=0, depth=2, op=LESS),
        TreeNode(3, parent=1, depth=3, op=LESS), TreeNode(4, parent=1, depth=3, op=LESS),
    ]
    return TreeTables(NUMERIC, nodes, digits=4)


def _causal_leaf_sql() -> str:
    cond = {
        "price > 250000.0000": "price > 250000",
        "price <= 250000.0000 and omonth <= 6.5000": "price <= 250000 AND omonth <= 6",
        "price <= 250000.0000 and omonth > 6.5000": "price <= 250000 AND omonth > 6",
    }
    parts = []
    for path, c in cond.items():
        tr, te = f"({c}) AND uid % 5 < 4", f"({c}) AND uid % 5 = 4"
        z = "(abs(p0 - p1) / sqrt(v1 / k1 + v0 / k0) / sqrt(2e0))"
        inner = ", ".join(
            f"avg(y) FILTER ({tr} AND treatment = {a}) AS p{a}, var_samp(y) FILTER ({tr} AND treatment = {a}) AS v{a}, "
            f"count(*) FILTER ({tr} AND treatment = {a}) AS k{a}, sum(y) FILTER ({te} AND treatment = {a}) AS s{a}, "
            f"count(*) FILTER ({te} AND treatment = {a}) AS n{a}" for a in (0, 1))
        parts.append(
            f"SELECT '{path}' AS path, {q6(erfc_sql(z))} AS p_value, {q6('p1 - p0')} AS uplift_train, "
            f"{q6('s1 / n1 - s0 / n0')} AS uplift_test, s1 AS sum_t_test, s0 AS sum_c_test, n1 AS num_t_test, "
            f"n0 AS num_c_test FROM (SELECT {inner} FROM units)")
    return with_(" UNION ALL ".join(parts), UNITS)


@query("causal_leaf_report_fixed", _causal_leaf_sql())
def causal_leaf_report_fixed(spark, sf_dir):
    df = units(spark, sf_dir)
    out = cf.tree_leaf_report(
        fixed_causal_tree(), df.where("uid % 5 < 4"), df.where("uid % 5 = 4"), "treatment", "y", binary=False)
    return rounded(out, "p_value", "uplift_train", "uplift_test")


@query("causal_node_report_fixed", with_(f"""
SELECT node_id, {q6('n1 / max(n1) OVER ()')} AS share_t_test, {q6('n0 / max(n0) OVER ()')} AS share_c_test,
       {q6('s1 / n1 - s0 / n0')} AS uplift_test, n1 AS num_t_test, n0 AS num_c_test
FROM ({_nodes_sql('*', {0: 'true', 1: 'price <= 250000', 2: 'price > 250000',
                        3: 'price <= 250000 AND omonth <= 6', 4: 'price <= 250000 AND omonth > 6'}, 'uid % 5 = 4')})""",
    UNITS))
def causal_node_report_fixed(spark, sf_dir):
    df = units(spark, sf_dir)
    out = cf.tree_node_report(
        fixed_causal_tree(), df.where("uid % 5 < 4"), df.where("uid % 5 = 4"), "treatment", "yb")
    out = out.select("node_id", "share_t_test", "share_c_test", "uplift_test", "num_t_test", "num_c_test")
    return rounded(out, "share_t_test", "share_c_test", "uplift_test")


def _impurity_sql(criterion: str, s: str) -> str:
    n1, n0, s1, s0, q1, q0 = (f"{c}_{s}{k}" for c in "nsq" for k in (1, 0))
    n = f"({n1} + {n0})"
    pen = f"0.25e0 * abs({n1} - {n0}) / {n}"
    if criterion == "standard_mse":
        return f"(({q1} + {q0}) / {n} - (({s1} + {s0}) / {n}) ** 2 + {pen})"
    return (f"((({q1} / {n1}) - ({s1} / {n1}) ** 2) / {n1} + (({q0} / {n0}) - ({s0} / {n0}) ** 2) / {n0} "
            f"- ({s1} / {n1} - {s0} / {n0}) ** 2 + {pen})")


def _causal_root_sql(criterion: str) -> str:
    """All splits of the root: running sums of centred outcomes along each feature, cut where it changes."""
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::double AS x, treatment AS t, y - (SELECT avg(y) FROM units) AS y FROM units"
                              for f in NUMERIC)
    parts = [(c, k, {"n": "1e0", "s": "y", "q": "y * y"}[c]) for c in "nsq" for k in (0, 1)]
    each = ", ".join(f"coalesce(sum({e}) FILTER (t = {k} AND y IS NOT NULL), 0)::double AS {c}{k}" for c, k, e in parts)
    upto = ", ".join(f"sum({c}{k}) OVER along AS {c}_l{k}, sum({c}{k}) OVER whole AS {c}_a{k}" for c, k, _ in parts)
    right = ", ".join(f"{c}_a{k} - {c}_l{k} AS {c}_r{k}" for c, k, _ in parts)
    n_l, n_r = "(n_l0 + n_l1)", "(n_r0 + n_r1)"
    if criterion == "t_test":
        tau = {s: f"(s_{s}1 / n_{s}1 - s_{s}0 / n_{s}0)" for s in "lr"}
        var = " + ".join(
            f"(q_{s}{k} / n_{s}{k} - (s_{s}{k} / n_{s}{k}) ** 2) / n_{s}{k}" for s in "lr" for k in (0, 1))
        gain = f"({tau['l']} - {tau['r']}) ** 2 / ({var})"
    else:
        gain = (f"{_impurity_sql(criterion, 'a')} - {n_l} / ({n_l} + {n_r}) * {_impurity_sql(criterion, 'l')} "
                f"- {n_r} / ({n_l} + {n_r}) * {_impurity_sql(criterion, 'r')}")
    return with_(f"""
SELECT feature, {q6('v')} AS threshold, {q6(gain)} AS gain, {n_l}::bigint AS n_left, {n_r}::bigint AS n_right
FROM sides WHERE v IS NOT NULL AND {n_l} >= 400 AND {n_r} >= 400""", UNITS, f"long AS ({long})",
        f"points AS (SELECT feature, x, {each} FROM long WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2)",
        f"""sums AS (SELECT feature, x + (lead(x) OVER along - x) / 2 AS v, {upto} FROM points
WINDOW along AS (PARTITION BY feature ORDER BY x), whole AS (PARTITION BY feature))""",
        f"sides AS (SELECT *, {right} FROM sums)")


def _causal_root(criterion: str):
    def run(spark, sf_dir):
        params = cf.CausalTreeParams(criterion=criterion, min_samples_leaf=400, groups_penalty=0.25)
        out = cf.causal_root_splits(units(spark, sf_dir), "uid", "treatment", "y", NUMERIC, params)
        return rounded(out, "threshold", "gain")

    return run


for _c in cf.CAUSAL_CRITERIA:
    query(f"causal_root_split_{_c}", _causal_root_sql(_c))(_causal_root(_c))


@query("causal_tree_report")
def causal_tree_report(spark, sf_dir):
    return cf.causal_tree_report(units(spark, sf_dir), "uid", "treatment", "y", NUMERIC, binary=False)[1]


@query("causal_tree_nodes")
def causal_tree_nodes(spark, sf_dir):
    return cf.causal_tree_report(
        units(spark, sf_dir), "uid", "treatment", "yb", NUMERIC, max_depth=4)[2]


def small_forests(trees: int = 3, min_leaf: int = 400) -> dict:
    """The forest grid with few trees and bounded depth, for quick runs."""
    return {
        name: replace(p, trees=trees, max_depth=min(p.max_depth or 4, 4))
        for name, p in cf.default_forest_grid(min_leaf).items()
    }


@query("causal_tree_grid")
def causal_tree_grid(spark, sf_dir):
    df = units(spark, sf_dir)
    grid = cf.default_tree_grid(400)
    return cf.predict_grid(df, cf.fit_grid(df, "uid", "treatment", "y", NUMERIC, grid)).select("uid", *grid)


@query("causal_forest_grid")
def causal_forest_grid(spark, sf_dir):
    df = units(spark, sf_dir)
    grid = small_forests()
    return cf.predict_grid(df, cf.fit_grid(df, "uid", "treatment", "y", NUMERIC, grid)).select("uid", *grid)


@query("causal_forest_grid_full")
def causal_forest_grid_full(spark, sf_dir):
    """All seven configurations with their hundred trees and own depths."""
    df = units(spark, sf_dir)
    grid = cf.default_forest_grid(400)
    return cf.predict_grid(df, cf.fit_grid(df, "uid", "treatment", "y", NUMERIC, grid)).select("uid", *grid)


@query("forest_importance")
def forest_importance(spark, sf_dir):
    df = units(spark, sf_dir)
    grid = {"cforest_cmse": cf.default_forest_grid(400)["cforest_cmse"]}
    model = cf.fit_grid(df, "uid", "treatment", "y", NUMERIC, grid)["cforest_cmse"]
    return model.importance_frame(spark).orderBy(F.desc("importance"), "feature")


@query("forest_leaf_values")
def forest_leaf_values(spark, sf_dir):
    df = units(spark, sf_dir)
    grid = {"cforest_ttest": cf.default_forest_grid(400)["cforest_ttest"]}
    model = cf.fit_grid(df, "uid", "treatment", "y", NUMERIC, grid)["cforest_ttest"]
    return cf.leaf_prediction_values(model, df)
