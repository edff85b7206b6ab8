"""Tables about fitted trees: paths, ancestors, node statistics and shares."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.functions.stats import safe_divide, z_p_value
from tauframe.operators.routing import FlatTrees, literal_array

GREATER, LESS, EQUAL = 0, 1, 2
TESTS = {GREATER: (">=", "<"), LESS: ("<=", ">"), EQUAL: ("==", "!=")}


@dataclass
class TreeNode:
    """One node; ``n``, ``s`` and ``q`` are row counts, sums and squares per arm."""

    id: int
    parent: int | None = None
    depth: int = 1
    feature: int = -1
    threshold: float = 0.0
    op: int = GREATER
    left: int = -1
    right: int = -1
    n: list = field(default_factory=list)
    s: list = field(default_factory=list)
    q: list = field(default_factory=list)
    p: list = field(default_factory=list)
    slope: float | None = None
    score: float | None = None
    credit: float = 0.0
    value: float | None = None

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


class TreeTables:
    """Structure and per-node statistics of one tree over named features."""

    def __init__(self, features, nodes, categories=None, digits: int | None = None):
        self.features = list(features)
        self.nodes: list[TreeNode] = nodes
        self.categories = dict(categories or {})
        self.digits = digits

    @property
    def depth(self) -> int:
        return max(n.depth for n in self.nodes)

    def leaves(self) -> list[TreeNode]:
        return [n for n in self.nodes if n.is_leaf]

    def flat(self) -> FlatTrees:
        k = self.nodes
        return FlatTrees(
            [n.feature if not n.is_leaf else -1 for n in k], [n.threshold for n in k],
            [n.op for n in k], [n.left for n in k], [n.right for n in k], [0], self.depth - 1,
        )

    def x_array(self) -> Column:
        """The features as one array of doubles, categories as their code."""
        return F.array(*[feature_value(f, self.categories) for f in self.features])

    def route(self, df: DataFrame, name: str = "leaf_id") -> DataFrame:
        """All rows with the id of the leaf they reach."""
        routed = self.flat().route(df.withColumn("_x", self.x_array()), "_x", name)
        return routed.drop("_x")

    def _condition(self, node: TreeNode, went_left: bool) -> str:
        name = self.features[node.feature]
        sign = TESTS[node.op][0 if went_left else 1]
        if node.op == EQUAL:
            return f"{name} {sign} {self.categories[name][int(node.threshold)]}"
        value = node.threshold if self.digits is None else f"{node.threshold:.{self.digits}f}"
        return f"{name} {sign} {value}"

    def lineage(self, node: TreeNode) -> list[TreeNode]:
        """The node and its ancestors, root first."""
        out = [node]
        while out[0].parent is not None:
            out.insert(0, self.nodes[out[0].parent])
        return out

    def path(self, node: TreeNode) -> str:
        line = self.lineage(node)
        return " and ".join(self._condition(a, a.left == b.id) for a, b in zip(line, line[1:]))

    def ancestors_frame(self, spark: SparkSession) -> DataFrame:
        """(leaf_id, node_id) for every node on the way to each leaf, itself included."""
        rows = [(leaf.id, n.id) for leaf in self.leaves() for n in self.lineage(leaf)]
        return spark.createDataFrame(rows, "leaf_id int, node_id int")

    def structure_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n.id, n.parent, n.depth, n.is_leaf,
             None if n.is_leaf else self.features[n.feature],
             None if n.is_leaf else TESTS[n.op][0],
             None if n.is_leaf else float(n.threshold), self.path(n))
            for n in self.nodes
        ]
        return spark.createDataFrame(
            rows, "node_id int, parent_id int, depth int, is_leaf boolean, feature string, "
                  "op string, threshold double, path string",
        )

    def node_moments(self, df: DataFrame, arm: Column, outcome: str, arms: int) -> DataFrame:
        """Counts n, sums s and squared deviations q per arm for every node.

        Rows are aggregated once by leaf. The ancestors' figures come from that small
        table; deviations are merged around the node's mean, never from raw squares.
        """
        routed = self.route(df.withColumn("_arm", arm))
        y = F.col(outcome).cast("double")
        mine = [F.when(F.col("_arm") == k, y) for k in range(arms)]
        leaf = routed.groupBy("leaf_id").agg(
            *[F.count(v).alias(f"n{k}") for k, v in enumerate(mine)],
            *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{k}") for k, v in enumerate(mine)],
            *[F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"q{k}") for k, v in enumerate(mine)],
        )
        parts = self.ancestors_frame(df.sparkSession).join(leaf, "leaf_id")
        node = Window.partitionBy("node_id")
        around = {
            f"d{k}": F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * F.pow(
                F.col(f"s{k}") / F.col(f"n{k}") - F.sum(f"s{k}").over(node) / F.sum(f"n{k}").over(node), 2
            )).otherwise(F.lit(0.0))
            for k in range(arms)
        }
        return parts.withColumns(around).groupBy("node_id").agg(
            *[F.sum(f"{c}{k}").alias(f"{c}{k}") for c in "ns" for k in range(arms)],
            *[F.sum(F.col(f"q{k}") + F.col(f"d{k}")).alias(f"q{k}") for k in range(arms)],
        )


def feature_value(name: str, categories: dict) -> Column:
    if name in categories:
        known = F.array(*[F.lit(v) for v in categories[name]])
        return (F.array_position(known, F.col(name)) - 1).cast("double")
    return F.col(name).cast("double")


def node_shares(moments: DataFrame) -> DataFrame:
    """Each node's rows relative to the root, per arm and in total, with its effect."""
    root = moments.where("node_id = 0").select(
        F.col("n0").alias("r0"), F.col("n1").alias("r1")
    ).first() or {"r0": 0, "r1": 0}
    n0, n1 = F.col("n0"), F.col("n1")
    return moments.select(
        "node_id", n1.alias("num_t"), n0.alias("num_c"),
        safe_divide(n1, F.lit(root["r1"])).alias("share_t"),
        safe_divide(n0, F.lit(root["r0"])).alias("share_c"),
        safe_divide(n0 + n1, F.lit(root["r0"] + root["r1"])).alias("share"),
        (safe_divide(F.col("s1"), n1) - safe_divide(F.col("s0"), n0)).alias("uplift"),
    )


def node_p_value(binary: bool) -> Column:
    """z p-value of a node's two arms from its moments."""
    n0, n1, s0, s1 = (F.col(c) for c in ("n0", "n1", "s0", "s1"))
    p0, p1 = safe_divide(s0, n0), safe_divide(s1, n1)
    if binary:
        return z_p_value(p0, n0, p1, n1)
    v0 = safe_divide(F.col("q0"), n0 - 1)
    v1 = safe_divide(F.col("q1"), n1 - 1)
    return z_p_value(p0, n0, p1, n1, v0, v1)


def node_values(tables: TreeTables) -> Column:
    """Literal array of node values indexed by node id."""
    return literal_array([float("nan") if n.value is None else n.value for n in tables.nodes], "double")
