"""Uplift trees for one or several treatment arms, grown level by level.

Each level is one pass: rows are routed to their node by look-up, exploded to
(node, feature, value) and reduced map-side to arm statistics per candidate bin.
Only the best split of each node reaches the driver, which holds the tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tauframe.functions.criteria import (
    UPLIFT_CRITERIA,
    node_score,
    slope,
    smoothed,
    split_normalizer,
    split_shares,
    total,
    uplift_gain,
)
from tauframe.operators.quantiles import percentiles
from tauframe.operators.routing import array_text
from tauframe.operators.sampling import honest_split, random_columns, split_by_flag
from tauframe.operators.tree_tables import (
    EQUAL,
    GREATER,
    TreeNode,
    TreeTables,
)
from tauframe.session import checkpoint, persist_spread

# Percentiles tried as thresholds of a feature with many values.
CANDIDATE_PERCENTILES = [3, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 97]
CANDIDATE_SHARES = [p / 100 for p in CANDIDATE_PERCENTILES]
FEW_VALUES = 10
VALIDATION_MIN_ROWS, VALIDATION_WEIGHT = 10, 100


@dataclass(frozen=True)
class UpliftTreeParams:
    control: str = "0"
    max_features: int | None = None
    max_depth: int = 3
    min_samples_leaf: int = 100
    min_samples_treatment: int = 10
    n_reg: float = 100.0
    criterion: str = "KL"
    normalization: bool = True
    seed: int = 0
    binary_outcome: bool = True
    validation_scale: float = 1.0

    def __post_init__(self):
        if self.criterion not in UPLIFT_CRITERIA:
            object.__setattr__(self, "criterion", "KL")


@dataclass
class UpliftTreeModel(TreeTables):
    """A fitted tree; node statistics are those of the growing rows."""

    features: list
    nodes: list
    categories: dict
    arms: list
    params: UpliftTreeParams
    digits: int | None = None
    importance: dict = field(default_factory=dict)
    center: float = 0.0

    def arm_index(self, treatment: str):
        known = F.array(*[F.lit(a) for a in self.arms])
        return (F.array_position(known, F.col(treatment).cast("string")) - 1).cast("int")

    def importance_frame(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): credited gain per feature, summing to one."""
        total = sum(self.importance.values())
        rows = [
            (f, self.importance.get(i, 0.0) / total if total else 0.0)
            for i, f in enumerate(self.features)
        ]
        return spark.createDataFrame(rows, "feature string, importance double")

    def decision(self, node: TreeNode) -> dict:
        """Arm differences, p-values and preferred arms of one node."""
        return arm_decision(node, self.params.binary_outcome)

    def nodes_frame(self, spark: SparkSession) -> DataFrame:
        """Every node with its split, score, arm statistics and decision."""
        rows = []
        for n in self.nodes:
            d = self.decision(n)
            rows.append((
                n.id, n.parent, n.depth, n.is_leaf,
                None if n.is_leaf else self.features[n.feature],
                None if n.is_leaf else float(n.threshold), self.path(n),
                n.score, int(sum(n.n)), [int(v) for v in n.n], [float(v) for v in n.s],
                [float(v) for v in n.p], d["diff"], d["p_value"],
                self.arms[d["best"]], d["best_diff"], self.arms[d["subopt"]], d["subopt_diff"],
                self.arms[d["widest"]], d["widest_sign"],
            ))
        return spark.createDataFrame(
            rows,
            "node_id int, parent_id int, depth int, is_leaf boolean, feature string, "
            "threshold double, path string, impurity double, samples long, n array<long>, "
            "sum_y array<double>, p array<double>, uplift_train array<double>, "
            "p_value array<double>, best_treatment string, best_diff double, "
            "subopt_treatment string, subopt_diff double, max_diff_treatment string, "
            "max_diff_sign int",
        )

    def fill(self, df: DataFrame, treatment: str, outcome: str) -> DataFrame:
        """Raw (unsmoothed) arm statistics of ``df`` in every node of the fixed tree."""
        arms = len(self.arms)
        moments = self.node_moments(df, self.arm_index(treatment), outcome, arms)
        mean = [F.coalesce(F.try_divide(F.col(f"s{k}"), F.col(f"n{k}").cast("double")), F.lit(0.0))
                for k in range(arms)]
        treated = range(1, arms)
        filled = moments.select(
            "node_id",
            sum((F.col(f"n{k}") for k in range(arms)), F.lit(0)).cast("long").alias("samples_test"),
            F.array(*mean).alias("p_test"),
            F.array(*[F.round(mean[k] - mean[0], 4) for k in treated]).alias("uplift_test"),
            F.array(*[F.col(f"n{k}") for k in treated]).alias("num_t_test"),
            F.col("n0").alias("num_c_test"),
            F.array(*[F.col(f"s{k}") for k in treated]).alias("sum_t_test"),
            F.col("s0").alias("sum_c_test"),
        )
        spark = df.sparkSession
        preferred = spark.createDataFrame(
            [(n.id, d["best"], d["subopt"]) for n in self.nodes for d in [self.decision(n)]],
            "node_id int, _best int, _subopt int",
        )
        gap = [F.round(F.get("p_test", F.col(c)) - F.get("p_test", F.lit(0)), 4)
               for c in ("_best", "_subopt")]
        # Nodes without a row of ``df`` have zeros.
        none = {"samples_test": F.lit(0).cast("long"), "num_c_test": F.lit(0).cast("long"), "sum_c_test": F.lit(0.0)}
        zeros = lambda n, kind: F.array(*[F.lit(0).cast(kind)] * n).cast(f"array<{kind}>")
        none |= {"p_test": zeros(arms, "double"), "num_t_test": zeros(arms - 1, "bigint")}
        none |= {c: zeros(arms - 1, "double") for c in ("uplift_test", "sum_t_test")}
        every = preferred.join(filled, "node_id", "left")
        every = every.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
        return every.withColumn("match_score", F.array(*gap)).drop("_best", "_subopt")

    def leaf_report(self, test: DataFrame, treatment: str, outcome: str) -> DataFrame:
        """Leaf paths with their effect on the growing rows and on ``test``."""
        spark = test.sparkSession
        trained = self.nodes_frame(spark).where("is_leaf").select(
            "node_id", "path", "best_treatment", "subopt_treatment", "p_value", "uplift_train",
        )
        filled = self.fill(test, treatment, outcome)
        report = F.broadcast(trained).join(filled, "node_id", "left").select(
            "path", "best_treatment", "subopt_treatment", "p_value", "uplift_train", "uplift_test",
            "num_t_test", "num_c_test", "sum_t_test", "sum_c_test",
        )
        if len(self.arms) > 2:
            return report
        one = ("p_value", "uplift_train", "uplift_test", "num_t_test", "sum_t_test")
        return report.select(
            "path", *[F.col(c)[0].alias(c) if c in one else c for c in report.columns[3:]]
        )


def display_list(column: str, digits: int | None = None):
    """An array as comma-joined text."""
    values = F.transform(column, lambda v: (F.round(v, digits) if digits else v).cast("string"))
    return F.array_join(values, ", ")


def arm_decision(node: TreeNode, binary: bool) -> dict:
    """Which arm to prefer in a node, from its per-arm means.

    The second choice is the arm with the largest difference to the control, the best
    is the same arm if that difference is a gain, else the control; the widest is the arm
    that differs most in either direction. Of equal differences the last arm counts.
    """
    gaps = [p - node.p[0] for p in node.p[1:]]
    treated = range(1, len(node.p))
    second = max(treated, key=lambda k: (gaps[k - 1], k), default=0)
    widest = max(treated, key=lambda k: (abs(gaps[k - 1]), k), default=0)
    gap_of = lambda k: gaps[k - 1] if k else 0.0
    best = second if gap_of(second) > 0 else 0
    return {
        "diff": [round(g, 4) for g in gaps], "p_value": [_gap_p_value(node, k, binary) for k in treated],
        "best": best, "best_diff": round(gap_of(best), 4),
        "subopt": second, "subopt_diff": round(gap_of(second), 4),
        "widest": widest, "widest_sign": int(math.copysign(1, gap_of(widest))) if gap_of(widest) else 0,
    }


def _gap_p_value(node: TreeNode, arm: int, binary: bool) -> float | None:
    """Two-sided z p-value of an arm's difference; None without rows or spread."""
    if not (node.n[arm] and node.n[0]):
        return None
    error = sum(_outcome_variance(node, k, binary) / node.n[k] for k in (arm, 0))
    if error <= 0:
        return None
    return round(math.erfc(abs(node.p[arm] - node.p[0]) / math.sqrt(2 * error)), 4)


def _outcome_variance(node: TreeNode, arm: int, binary: bool) -> float:
    if binary:
        return node.p[arm] * (1 - node.p[arm])
    return node.q[arm] / node.n[arm]


def learn_arms(df: DataFrame, treatment: str, control: str) -> list[str]:
    """Arm labels, control first and the others in text order."""
    found = [r[0] for r in df.select(F.col(treatment).cast("string")).distinct().collect()]
    return [control, *sorted(a for a in found if a is not None and a != control)]


def learn_categories(df: DataFrame, columns, min_rows: int) -> dict[str, list]:
    """Values frequent enough to be a child on their own, per text column.

    A value with fewer rows than a leaf needs can never be split off, so leaving
    it out changes no tree and bounds the list by rows / min_rows.
    """
    out = {}
    for c in columns:
        rows = df.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") >= min_rows)
        out[c] = sorted(r[0] for r in rows.collect())
    return out


class _Level:
    """The candidate and gain tables of one level."""

    def __init__(self, base: DataFrame, model: UpliftTreeModel, active: list[TreeNode],
                 allowed: dict[int, list[int]] | None, validated: bool):
        self.base, self.model, self.active = base, model, active
        self.allowed, self.validated = allowed, validated
        self.coded = [i for i, f in enumerate(model.features) if f in model.categories]
        self.arms = range(len(model.arms))

    def _by_node(self, values: dict[int, float], kind: str) -> str:
        """Text that looks a figure up by node id."""
        return f"get({array_text([values.get(n.id, 0) for n in self.model.nodes], kind)}, node)"

    def _long(self) -> DataFrame:
        routed = self.model.flat().route_once(self.base, "x", "node", ["arm", "y", "held", "x"])
        ids = ", ".join(str(n.id) for n in self.active)
        long = routed.where(f"node IN ({ids})").selectExpr(
            "node", "arm", "y", "held", "posexplode(x) AS (f, v)"
        )
        if self.allowed is None:
            return long
        width = len(self.model.features)
        flags = [0] * (len(self.model.nodes) * width)
        for node, features in self.allowed.items():
            for f in features:
                flags[node * width + f] = 1
        return long.where(f"get({array_text(flags, 'int')}, node * {width} + f) = 1")

    def candidates(self) -> DataFrame:
        """(node, f, cand): ascending thresholds, or the codes of a text column."""
        counts = (
            self._long().where("v is not null and not held").groupBy("node", "f", "v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        by = ["node", "f"]
        parts = []
        plain = [i for i in range(len(self.model.features)) if i not in self.coded]
        if plain:
            stats = percentiles(counts.where(F.col("f").isin(plain)), by, "v", CANDIDATE_SHARES, FEW_VALUES)
            parts.append(stats.selectExpr(
                *by, f"CASE WHEN distinct_values > {FEW_VALUES} "
                     "THEN array_distinct(array_sort(percentiles)) ELSE lowest END AS cand"
            ))
        if self.coded:
            codes = counts.where(F.col("f").isin(self.coded) & (F.col("v") >= 0))
            parts.append(codes.groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("cand")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _is_coded(self) -> str:
        return f"f IN ({', '.join(map(str, self.coded))})" if self.coded else "false"

    def _names(self) -> list[str]:
        kinds = "nsq" + ("uw" if self.validated else "")
        return [f"{c}{k}" for c in kinds for k in self.arms]

    def binned(self) -> DataFrame:
        """Arm statistics per (node, f, bin) with the threshold that opens the bin."""
        cand = checkpoint(self.candidates())  # small, and read twice below
        reached = " + ".join(
            f"coalesce(cast(get(cand, {i}) <= v AS int), 0)" for i in range(len(CANDIDATE_SHARES))
        )
        bin_ = (
            f"CASE WHEN {self._is_coded()} THEN cast(coalesce(array_position(cand, v), 0) AS int) "
            f"ELSE {reached} END"
        )
        # at most nodes x features rows of 13 thresholds
        rows = self._long().join(F.broadcast(cand), ["node", "f"]).withColumn("bin", F.expr(bin_))
        aggregates = []
        for k in self.arms:
            mine = f"arm = {k} AND NOT held"
            aggregates += [
                f"count_if({mine}) AS n{k}", f"sum(CASE WHEN {mine} THEN y ELSE 0D END) AS s{k}",
                f"sum(CASE WHEN {mine} THEN pow(y - {self.model.center!r}D, 2) ELSE 0D END) AS q{k}",
            ]
            if self.validated:
                aggregates += [
                    f"count_if(arm = {k} AND held) AS u{k}",
                    f"sum(CASE WHEN arm = {k} AND held THEN y ELSE 0D END) AS w{k}",
                ]
        stats = rows.groupBy("node", "f", "bin").agg(*[F.expr(a) for a in aggregates])
        names = self._names()
        # every candidate gets a row even when no value falls in its bin
        empty = cand.selectExpr("node", "f", "posexplode(cand) AS (i, value)").selectExpr(
            "node", "f", "i + 1 AS bin", "value",
            *[f"{'0L' if c[0] in 'nu' else '0D'} AS {c}" for c in names],
        )
        both = stats.withColumn("value", F.expr("cast(NULL AS double)")).unionByName(empty)
        return both.groupBy("node", "f", "bin").agg(
            F.max("value").alias("value"), *[F.sum(c).alias(c) for c in names]
        )

    def splits(self) -> DataFrame:
        """Every admissible candidate with its gain and both children's figures."""
        params, arms = self.model.params, self.arms
        criterion = params.criterion
        names = self._names()
        above = ("OVER (PARTITION BY node, f ORDER BY bin DESC "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        whole = "OVER (PARTITION BY node, f)"
        sides = self.binned().selectExpr(
            "node", "f", "bin", "value",
            *[f"CASE WHEN {self._is_coded()} THEN {c} ELSE sum({c}) {above} END AS {c[0]}_l{c[1:]}"
              for c in names],
            *[f"sum({c}) {whole} AS {c[0]}_a{c[1:]}" for c in names],
        ).where("bin > 0")
        parent = [self._by_node({n.id: n.p[k] for n in self.active}, "double") for k in arms]
        score = self._by_node({n.id: n.score or 0.0 for n in self.active}, "double")
        sides = sides.selectExpr(
            "*", f"{score} AS score", *[f"{p} AS parent{k}" for k, p in zip(arms, parent)],
            *[f"{c[0]}_a{c[1:]} - {c[0]}_l{c[1:]} AS {c[0]}_r{c[1:]}" for c in names],
        ).selectExpr("*", *[f"{total(f'n_{s}', arms)} AS rows_{s}" for s in "lr"])
        valid = [f"rows_{s} > {params.min_samples_leaf}" for s in "lr"]
        valid += [f"n_{s}{k} >= {params.min_samples_treatment}" for s in "lr" for k in arms]
        sides = sides.where(" AND ".join(valid)).selectExpr(
            "*",
            *[f"{smoothed(s, k, f'parent{k}', params.min_samples_treatment, params.n_reg)} AS p_{s}{k}"
              for s in "lr" for k in arms],
            *[f"{slope(s, arms)} AS slope_{s}" for s in "lr"],
        )
        sides = self._hold_up(sides) if self.validated else sides.selectExpr("*", "true AS admissible")
        columns = {f"score_{s}": node_score(criterion, s, arms) for s in "lr"}
        if params.normalization:
            columns.update(split_shares(arms))
        sides = sides.selectExpr("*", *[f"{e} AS {c}" for c, e in columns.items()])
        normalizer = split_normalizer(arms) if params.normalization else None
        gain, credit = uplift_gain(criterion, normalizer)
        child = ", ".join
        return sides.selectExpr(
            "node", "f", "value", f"{gain} AS gain", f"{credit} AS credit",
            "rows_l AS n_left", "rows_r AS n_right",
            *[f"array({child(f'cast({c}_{s}{k} AS double)' for c in 'nsqp' for k in arms)}) AS {name}"
              for s, name in (("l", "left_stats"), ("r", "right_stats"))],
            "array(score_l, score_r) AS scores", "array(slope_l, slope_r) AS slopes", "admissible",
        )

    def _hold_up(self, sides: DataFrame) -> DataFrame:
        """Only splits whose rates and slope are close on the held rows as well."""
        arms, scale = self.arms, self.model.params.validation_scale
        held = sides.selectExpr(
            "*", *[f"u_{s}{k} AS n_h{s}{k}" for s in "lr" for k in arms],
            *[f"w_{s}{k} AS s_h{s}{k}" for s in "lr" for k in arms],
        )
        held = held.selectExpr(
            "*",
            *[f"{smoothed(f'h{s}', k, f'parent{k}', VALIDATION_MIN_ROWS, VALIDATION_WEIGHT)} AS p_h{s}{k}"
              for s in "lr" for k in arms],
            *[f"{slope(f'h{s}', arms)} AS slope_h{s}" for s in "lr"],
        )
        pairs = [(f"p_{s}{k}", f"p_h{s}{k}") for s in "lr" for k in arms]
        pairs += [(f"slope_{s}", f"slope_h{s}") for s in "lr"]
        far = [f"coalesce(abs({b} - {a}) > least({a}, {b}) / {scale}D, false)" for a, b in pairs]
        return held.selectExpr("*", f"NOT ({' OR '.join(far)}) AS admissible")

    def best(self) -> list:
        """The best split of each node; ties go to the first feature and lowest value."""
        # a condition inside the aggregate keeps the gain from being copied into a filter
        rank = F.expr("min(CASE WHEN admissible AND gain > 0 THEN struct(-round(gain, 12) AS loss, "
                      "f, value, credit, left_stats, right_stats, scores, slopes) END)")
        best = self.splits().groupBy("node").agg(rank.alias("b")).where("b IS NOT NULL")
        return best.select("node", "b.*").collect()


def _root_figures(model: UpliftTreeModel) -> list[str]:
    """Rates, slope and score of a node from its own counts and sums."""
    arms = range(len(model.arms))
    rates = [f"coalesce(try_divide(s_a{k}, n_a{k}), 0D) AS p_a{k}" for k in arms]
    return [*rates, f"{slope('a', arms)} AS slope_a"]


def _base(train, validation, model, treatment, outcome):
    def shape(df, held):
        return df.select(
            model.arm_index(treatment).alias("arm"), F.col(outcome).cast("double").alias("y"),
            model.x_array().alias("x"), F.lit(held).alias("held"),
        ).where(F.col("arm").isNotNull() & F.col("y").isNotNull())

    base = shape(train, False)
    return base if validation is None else base.unionByName(shape(validation, True))


def start_model(train: DataFrame, treatment: str, features, params: UpliftTreeParams) -> UpliftTreeModel:
    text = [f for f in features if isinstance(train.schema[f].dataType, StringType)]
    return UpliftTreeModel(
        features=list(features), nodes=[],
        categories=learn_categories(train, text, params.min_samples_leaf),
        arms=learn_arms(train, treatment, params.control), params=params,
    )


def _plant(base: DataFrame, model: UpliftTreeModel) -> None:
    """Add the root."""
    arms = range(len(model.arms))
    mine = [f"CASE WHEN arm = {k} THEN y END" for k in arms]
    sums = base.where("NOT held").agg(*[F.expr(e) for e in [
        *[f"count({m}) AS n_a{k}" for k, m in zip(arms, mine)],
        *[f"coalesce(sum({m}), 0D) AS s_a{k}" for k, m in zip(arms, mine)],
        *[f"coalesce(var_pop({m}) * count({m}), 0D) AS q_a{k}" for k, m in zip(arms, mine)],
        "coalesce(avg(y), 0D) AS center",
    ]])
    r = sums.selectExpr("*", *_root_figures(model)).selectExpr(
        "*", f"{node_score(model.params.criterion, 'a', arms)} AS score"
    ).first()
    model.center = r["center"]
    model.nodes.append(TreeNode(
        0, n=[r[f"n_a{k}"] for k in arms], s=[r[f"s_a{k}"] for k in arms],
        q=[r[f"q_a{k}"] for k in arms], p=[r[f"p_a{k}"] for k in arms],
        slope=r["slope_a"], score=r["score"],
    ))


def root_splits(train: DataFrame, treatment: str, outcome: str, features, params: UpliftTreeParams):
    """Every admissible split of the root with its gain: (feature, threshold, gain, sizes)."""
    model = start_model(train, treatment, features, params)
    base = _base(train, None, model, treatment, outcome)
    _plant(base, model)
    level = _Level(base, model, model.nodes, None, False)
    names = F.array(*[F.lit(f) for f in model.features])
    return level.splits().select(
        F.get(names, F.col("f")).alias("feature"), F.col("value").alias("threshold"),
        "gain", "n_left", "n_right",
    )


def fit_uplift_tree(
    train: DataFrame, treatment: str, outcome: str, features, params: UpliftTreeParams,
    validation: DataFrame | None = None,
) -> UpliftTreeModel:
    """Grow a tree; with ``validation`` a split must hold up there as well."""
    model = start_model(train, treatment, features, params)
    base = persist_spread(_base(train, validation, model, treatment, outcome))
    try:
        _plant(base, model)
        active = list(model.nodes)
        everything = list(range(len(model.features)))
        while active and active[0].depth < params.max_depth:
            allowed = None
            if params.max_features and 0 < params.max_features < len(everything):
                allowed = {
                    n.id: random_columns(everything, params.max_features, (params.seed, n.id))
                    for n in active
                }
            level = _Level(base, model, active, allowed, validation is not None)
            made = []
            for row in sorted(level.best(), key=lambda r: r["node"]):
                made += _split(model, row)
            active = made
    finally:
        base.unpersist()
    return model


def _split(model: UpliftTreeModel, row) -> list[TreeNode]:
    node = model.nodes[row["node"]]
    node.feature, node.threshold = row["f"], row["value"]
    node.op = EQUAL if model.features[row["f"]] in model.categories else GREATER
    node.credit = row["credit"]
    model.importance[node.feature] = model.importance.get(node.feature, 0.0) + node.credit
    k = len(model.arms)
    made = []
    for side, stats in enumerate((row["left_stats"], row["right_stats"])):
        n, s = [int(v) for v in stats[:k]], list(stats[k:2 * k])
        # Squares were taken around the center; deviations are around the node's means.
        q = [max(0.0, v - c * (m / c - model.center) ** 2) if c else 0.0
             for v, c, m in zip(stats[2 * k:3 * k], n, s)]
        child = TreeNode(
            len(model.nodes), parent=node.id, depth=node.depth + 1, n=n, s=s, q=q,
            p=list(stats[3 * k:]), score=row["scores"][side], slope=row["slopes"][side],
        )
        model.nodes.append(child)
        made.append(child)
    node.left, node.right = made[0].id, made[1].id
    return made


def refill(model: UpliftTreeModel, df: DataFrame, treatment: str, outcome: str) -> UpliftTreeModel:
    """The same splits with every node re-estimated on other rows (honest estimates).

    Nodes take their own raw rates; a node no row reaches keeps its old figures.
    """
    arms = range(len(model.arms))
    moments = model.node_moments(df, model.arm_index(treatment), outcome, len(model.arms))
    renamed = moments.selectExpr("node_id", *[f"{c}{k} AS {c}_a{k}" for c in "nsq" for k in arms])
    scored = renamed.selectExpr("*", *_root_figures(model)).selectExpr(
        "*", f"{node_score(model.params.criterion, 'a', arms)} AS score")
    for r in scored.collect():
        node = model.nodes[r["node_id"]]
        node.n, node.s, node.q, node.p = ([r[f"{c}_a{k}"] for k in arms] for c in "nsqp")
        node.score, node.slope = r["score"], r["slope_a"]
    return model


def uplift_tree(
    df: DataFrame, id_col: str, treatment: str, outcome: str, features,
    params: UpliftTreeParams | None = None, train_flag: str | None = None,
    min_leaf_share: float = 0.01, honest: bool = False, estimation_share: float = 0.5, seed: int = 25,
) -> tuple[UpliftTreeModel, DataFrame]:
    """Split, fit, fill with the test rows and report the leaves.

    Without a train flag 80% of the units are drawn for training. The minimum
    leaf is a share of the training rows. Returns the model and the leaf report.
    """
    from dataclasses import replace

    train, test = split_by_flag(df, train_flag, id_col, 0.8, seed)
    slim = train.select(*dict.fromkeys([id_col, treatment, outcome, *features])).persist()
    try:
        rows = slim.count()
        params = replace(
            params or UpliftTreeParams(max_depth=5), min_samples_leaf=int(rows * min_leaf_share))
        if honest:
            growth, estimation = honest_split(slim, id_col, estimation_share, seed)
            model = fit_uplift_tree(growth, treatment, outcome, features, params)
            model = refill(model, estimation, treatment, outcome)
        else:
            model = fit_uplift_tree(slim, treatment, outcome, features, params)
    finally:
        slim.unpersist()
    return model, model.leaf_report(test, treatment, outcome)


def fixed_tree(features, splits: dict, arms=("0", "1"), params=None, categories=None) -> UpliftTreeModel:
    """A tree with given splits: ``{node: (feature, threshold, left, right)}``."""
    size = max([0, *[c for s in splits.values() for c in s[2:4]]]) + 1
    nodes = [TreeNode(i, n=[0] * len(arms), s=[0.0] * len(arms), q=[0.0] * len(arms),
                      p=[0.0] * len(arms)) for i in range(size)]
    for i in sorted(splits):
        feature, threshold, left, right = splits[i]
        node = nodes[i]
        node.feature, node.threshold = list(features).index(feature), threshold
        node.op = EQUAL if feature in (categories or {}) else GREATER
        node.left, node.right = left, right
        for child in (left, right):
            nodes[child].parent, nodes[child].depth = i, node.depth + 1
    return UpliftTreeModel(list(features), nodes, dict(categories or {}), list(arms),
                           params or UpliftTreeParams())
