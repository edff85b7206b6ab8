"""Causal trees and forests for a binary arm, whole grids grown together.

Splits are exact: every threshold between neighbouring values of a node is tried, on
presorted feature lists (:mod:`tauframe.operators.presorted`). Large nodes are split level
by level; the driver reads one best split for each of them, and nodes are sent to tasks in
bounded chunks. Nodes of bounded size are finished in tasks of their own. The driver holds
the fitted trees. A tree without a depth limit has at most rows / ``min_samples_leaf``
leaves, which is then the size of the model.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import RDD, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tauframe.operators import presorted
from tauframe.operators.describe import group_effect_stats
from tauframe.operators.presorted import CRITERIA, STATS, Frontier
from tauframe.operators.sampling import split_by_flag
from tauframe.operators.tree_tables import (
    LESS,
    TreeNode,
    TreeTables,
    node_p_value,
    node_shares,
)
from tauframe.session import persist_spread, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAUSAL_CRITERIA = CRITERIA
TREES_PER_PASS = 256
#: Trees from which on rows are dealt to all cores before they are sent through them.
MANY_TREES = 16


@dataclass(frozen=True)
class CausalTreeParams:
    criterion: str = "causal_mse"
    max_depth: int | None = None
    min_samples_leaf: int = 100
    min_impurity_decrease: float = 0.0
    groups_penalty: float = 0.0
    trees: int = 1
    bootstrap: bool = False
    seed: int = 0

    def __post_init__(self):
        if self.criterion not in CAUSAL_CRITERIA:
            raise ValueError(f"criterion must be one of {CAUSAL_CRITERIA}")


# The configurations of the two default grids below.
def default_tree_grid(min_samples_leaf: int = 400) -> dict[str, CausalTreeParams]:
    """Six single-tree configurations."""
    base = CausalTreeParams(min_samples_leaf=min_samples_leaf, max_depth=6)
    return {
        "ctree_mse": replace(base, criterion="standard_mse", max_depth=None),
        "ctree_cmse": base,
        "ctree_cmse_p010": replace(base, groups_penalty=0.1),
        "ctree_cmse_p025": replace(base, groups_penalty=0.25),
        "ctree_cmse_p050": replace(base, groups_penalty=0.5),
        "ctree_ttest": replace(base, criterion="t_test"),
    }


def default_forest_grid(min_samples_leaf: int = 400, trees: int = 100) -> dict[str, CausalTreeParams]:
    """Seven forest configurations."""
    base = CausalTreeParams(min_samples_leaf=min_samples_leaf, trees=trees, bootstrap=True)
    return {
        "cforest_mse": replace(base, criterion="standard_mse"),
        "cforest_cmse": base,
        "cforest_cmse_p020": replace(base, groups_penalty=0.2),
        "cforest_cmse_p020_md5": replace(base, groups_penalty=0.2, max_depth=5),
        "cforest_cmse_p050": replace(base, groups_penalty=0.5),
        "cforest_cmse_p050_md5": replace(base, groups_penalty=0.5, max_depth=5),
        "cforest_ttest": replace(base, criterion="t_test"),
    }


@dataclass
class CausalForestModel:
    """One configuration's trees; a single tree is a forest of one."""

    features: list
    trees: list[TreeTables]
    params: CausalTreeParams
    importances: dict = field(default_factory=dict)

    def arrays(self) -> tuple[Frontier, np.ndarray]:
        """The trees as flat arrays, and the value of every node."""
        nodes, roots = [], []
        for tree in self.trees:
            roots.append(len(nodes))
            nodes += [(n, roots[-1]) for n in tree.nodes]
        return _flat(nodes, roots, max(t.depth for t in self.trees) - 1), np.array(
            [np.nan if n.value is None else n.value for n, _ in nodes])

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """Add the estimated effect of every row: its leaf's value, averaged over trees."""
        return predict_grid(df, {name: self})

    def importance_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(self.importances.get(i, 0.0))) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "feature string, importance double")


def _flat(nodes: list[tuple[TreeNode, int]], roots: list[int], depth: int, **more) -> Frontier:
    """Nodes with the shift of their tree's numbers as flat arrays."""
    leaf = [n.is_leaf for n, _ in nodes]
    return Frontier(
        feature=np.array([-1 if stop else n.feature for (n, _), stop in zip(nodes, leaf)], dtype=np.int32),
        threshold=np.array([n.threshold for n, _ in nodes], dtype=np.float64),
        left=np.array([-1 if stop else n.left + shift for (n, shift), stop in zip(nodes, leaf)], dtype=np.int64),
        right=np.array([-1 if stop else n.right + shift for (n, shift), stop in zip(nodes, leaf)], dtype=np.int64),
        roots=np.array(roots, dtype=np.int64), depth=depth,
        **{"slot": None, "trees": None, "seeds": None, "bootstrap": None, **more})


@dataclass
class _Slot:
    """One tree being grown: its configuration and its nodes' place in the flat arrays."""

    kind: CausalTreeParams
    number: int
    params: CausalTreeParams
    nodes: list = field(default_factory=list)


class _Lists:
    """The rows, what scans of large nodes need and what whole trees read, each made when first needed."""

    def __init__(self, rows: DataFrame, features: int):
        self.rows, self.features = rows, features

    @cached_property
    def count(self) -> int:
        return self.rows.count()

    @cached_property
    def few(self) -> dict[int, np.ndarray]:
        return presorted.few_values(self.rows, self.features)

    @cached_property
    def _lists(self) -> DataFrame | None:
        many = [i for i in range(self.features) if i not in self.few]
        return presorted.feature_lists(self.rows, self.features, many) if many else None

    @cached_property
    def blocks(self) -> RDD:
        return presorted.row_blocks(self.rows, self.few)

    def get(self) -> tuple[DataFrame | None, dict[int, np.ndarray]]:
        """Sorted lists of the features with many values, and the values of the others."""
        return self._lists, self.few

    def fits_task(self, bootstrap: bool) -> bool:
        """Whether a task can hold the rows of a whole tree, a byte for each feature of few values."""
        drawn = self.count * (1 - np.exp(-1.0) if bootstrap else 1.0)
        most = presorted.WHOLE * presorted.LOCAL_ROWS
        # Three features of many values, as bytes go.
        return drawn <= most and drawn * (9 + 8 * self.features - 7 * len(self.few)) <= most * 33

    def unpersist(self) -> None:
        if self.__dict__.get("_lists") is not None:
            self._lists.unpersist()
        if "blocks" in self.__dict__:
            self.blocks.unpersist()
        self.rows.unpersist()


class _Grower:
    """Grows the trees of one pass; node ids count inside each tree."""

    def __init__(self, rows: DataFrame, lists: _Lists | None, slots: list[_Slot]):
        self.rows, self.lists, self.slots = rows, lists, slots

    def _add(self, slot: _Slot, parent: int | None, stats: np.ndarray) -> TreeNode:
        n_t, s_t, q_t, n_c, s_c, q_c = (float(v) for v in stats)
        node = TreeNode(
            len(slot.nodes), parent=parent, op=LESS, depth=1 if parent is None else slot.nodes[parent].depth + 1,
            n=[n_c, n_t], s=[s_c, s_t], q=[q_c, q_t])
        node.value = s_t / n_t - s_c / n_c if n_t and n_c else None
        slot.nodes.append(node)
        return node

    def frontier(self, open_: list[tuple[_Slot, TreeNode]]) -> Frontier:
        """The nodes to split and the trees they are in."""
        slots = list({id(s): s for s, _ in open_}.values())
        nodes, roots, shift = [], [], {}
        for s in slots:
            shift[id(s)] = len(nodes)
            roots.append(len(nodes))
            nodes += [(n, roots[-1]) for n in s.nodes]
        place = np.full(len(nodes), -1, dtype=np.int64)
        for i, (s, n) in enumerate(open_):
            place[shift[id(s)] + n.id] = i
        of = lambda value, kind=np.float64: np.array([value(s) for s, _ in open_], dtype=kind)
        return _flat(
            nodes, roots, max(n.depth for _, n in open_) - 1, slot=place,
            trees=np.array([s.number for s in slots]), seeds=np.array([s.params.seed for s in slots]),
            bootstrap=np.array([s.params.bootstrap for s in slots]),
            stats=np.array([[n.n[1], n.s[1], n.q[1], n.n[0], n.s[0], n.q[0]] for _, n in open_]).reshape(-1, 6),
            code=of(lambda s: CRITERIA.index(s.params.criterion), np.int64), penalty=of(lambda s: s.params.groups_penalty),
            min_leaf=of(lambda s: s.params.min_samples_leaf), min_drop=of(lambda s: s.params.min_impurity_decrease),
            total=of(lambda s: max(1.0, sum(s.nodes[0].n))),
            levels=np.array([np.inf if s.params.max_depth is None else s.params.max_depth + 1 - n.depth for s, n in open_]))

    def plant(self) -> list[tuple[_Slot, TreeNode]]:
        start = [(s, self._add(s, None, np.zeros(6))) for s in self.slots]
        totals = presorted.node_totals(self.rows, self.frontier(start))
        for s in self.slots:
            s.nodes.clear()
        return [(s, self._add(s, None, t)) for s, t in zip(self.slots, totals)]

    def grow(self) -> None:
        every, whole = self.slots, [s for s in self.slots if self.lists.fits_task(s.params.bootstrap)]
        # The driver reads a pass of finished trees at once.
        leaves = sum(self.lists.count / max(1, s.params.min_samples_leaf) for s in whole) / max(1, len(whole))
        step = max(1, int(presorted.NODES / (2 * leaves + 1)))
        for first in range(0, len(whole), step):
            self._grow_whole(whole[first:first + step])
        self.slots = [s for s in every if all(s is not w for w in whole)]
        if self.slots:
            self._grow_by_level()
        self.slots = every
        for s in self.slots:
            s.nodes = _by_level(s.nodes)

    def _grow_whole(self, slots: list[_Slot]) -> None:
        """Trees whose tasks read all rows."""
        start = [(s, self._add(s, None, np.zeros(6))) for s in slots]
        for found in presorted.whole_trees(self.lists.blocks, self.lists.features, self.frontier(start), self.lists.few):
            slot = slots[found.column("a")[0].as_py()]
            slot.nodes.clear()
            stats = np.stack([found.column(c).to_numpy() for c in STATS], 1)
            self._attach(slot, self._add(slot, None, stats[0]), *(
                found.column(c).to_numpy() for c in ("f", "threshold", "credit", "left")), stats)

    def _grow_by_level(self) -> None:
        level, small = self._open(self.plant()), []
        while level:
            small += [(s, n) for s, n in level if sum(n.n) <= presorted.LOCAL_ROWS]
            level = self._open(self._split([(s, n) for s, n in level if sum(n.n) > presorted.LOCAL_ROWS]))
        if small:
            self._finish(small)

    def _split(self, level: list[tuple[_Slot, TreeNode]]) -> list[tuple[_Slot, TreeNode]]:
        """Split nodes by scans over all rows; returns their children."""
        if not level:
            return []
        lists, few = self.lists.get()
        parts = max(1, (lists if lists is not None else self.rows).rdd.getNumPartitions())
        chunk = max(1, presorted.OFFSETS // (2 * parts))
        made = []
        for first in range(0, len(level), chunk):
            some = level[first:first + chunk]
            best = presorted.best_splits(lists, self.frontier(some), self.rows, few)
            for row in sorted(best.collect(), key=lambda r: r["a"]):
                slot, node = some[row["a"]]
                made += self._divide(slot, node, row["f"], row["threshold"], row["credit"], np.array([row[c] for c in STATS]))
        return made

    def _divide(self, slot: _Slot, node: TreeNode, feature, threshold, credit, left) -> list[tuple[_Slot, TreeNode]]:
        node.feature, node.threshold, node.credit = feature, threshold, credit
        whole = np.array([node.n[1], node.s[1], node.q[1], node.n[0], node.s[0], node.q[0]])
        pair = [self._add(slot, node.id, side) for side in (left, whole - left)]
        node.left, node.right = pair[0].id, pair[1].id
        return [(slot, n) for n in pair]

    def _finish(self, small: list[tuple[_Slot, TreeNode]]) -> None:
        """Split nodes to the end, each from its own rows in one task."""
        found = presorted.subtrees(self.rows, self.frontier(small)).toArrow().sort_by([("a", "ascending"), ("node", "ascending")])
        a, feature, threshold, credit, left = (
            found.column(c).to_numpy() for c in ("a", "f", "threshold", "credit", "left"))
        stats = np.stack([found.column(c).to_numpy() for c in STATS], 1) if len(a) else np.zeros((0, 6))
        edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else []
        for low, high in zip(edges, edges[1:]):
            self._attach(*small[a[low]], *(c[low:high] for c in (feature, threshold, credit, left, stats)))

    def _attach(self, slot: _Slot, top: TreeNode, feature, threshold, credit, left, stats) -> None:
        """Add a finished subtree below its top node."""
        node = {0: top}
        # Children have higher numbers than their parents.
        for i, side in enumerate(left.tolist()):
            if side >= 0:
                pair = self._divide(slot, node.pop(i), int(feature[i]), float(threshold[i]), float(credit[i]), stats[side])
                node[side], node[side + 1] = pair[0][1], pair[1][1]

    @staticmethod
    def _open(nodes: list[tuple[_Slot, TreeNode]]) -> list[tuple[_Slot, TreeNode]]:
        """Nodes that are shallow and large enough to be split further."""
        return [
            (s, n) for s, n in nodes
            if (s.params.max_depth is None or n.depth <= s.params.max_depth)
            and sum(n.n) >= 2 * s.params.min_samples_leaf]


def _by_level(nodes: list[TreeNode]) -> list[TreeNode]:
    """The nodes numbered level by level, each parent's left child before its right one."""
    order = [nodes[0]]
    for node in order:
        if not node.is_leaf:
            order += [nodes[node.left], nodes[node.right]]
    number = {id(n): i for i, n in enumerate(order)}
    link = [
        (None if n.parent is None else number[id(nodes[n.parent])],
         *((n.left, n.right) if n.is_leaf else (number[id(nodes[n.left])], number[id(nodes[n.right])])))
        for n in order]
    for i, (node, (parent, left, right)) in enumerate(zip(order, link)):
        node.id, node.parent, node.left, node.right = i, parent, left, right
    return order


def _cut_off(nodes: list[TreeNode], max_depth: int | None) -> list[TreeNode]:
    """The tree that a lower depth limit would have given; nodes are numbered by level."""
    if max_depth is None:
        return nodes
    return [
        replace(n, feature=-1, threshold=0.0, left=-1, right=-1, credit=0.0) if n.depth > max_depth else n
        for n in nodes if n.depth <= max_depth + 1]


def _source(train: DataFrame, id_col: str, treatment: str, outcome: str, features) -> DataFrame:
    # Effects and spreads do not change when a constant is taken off all outcomes, and
    # squares of centred outcomes stay exact whatever the outcome's level.
    y = F.col(outcome).cast("double")
    center = train.agg(F.coalesce(F.avg(y), F.lit(0.0)).alias("m")).first()["m"]
    return presorted.row_source(train, id_col, treatment, y - F.lit(center), features)


def causal_root_splits(
    train: DataFrame, id_col: str, treatment: str, outcome: str, features, params: CausalTreeParams
) -> DataFrame:
    """All admissible first splits of a single tree with their gains."""
    features = list(features)
    rows = _source(train, id_col, treatment, outcome, features)
    grower = _Grower(rows, None, [_Slot(params, 0, params)])
    found = presorted.all_splits(presorted.feature_lists(rows, len(features)), grower.frontier(grower.plant()))
    names = F.array(*[F.lit(f) for f in features])
    return found.select(F.get(names, F.col("f")).alias("feature"), "threshold", "gain", "n_left", "n_right")


def fit_grid(
    train: DataFrame, id_col: str, treatment: str, outcome: str, features,
    grid: dict[str, CausalTreeParams], trees_per_pass: int = TREES_PER_PASS,
) -> dict[str, CausalForestModel]:
    """Fit every configuration; trees of all configurations share the scans.

    Configurations that differ in their depth limits only grow the same trees: the deepest
    ones are grown and cut off at the others' limits.
    """
    features = list(features)
    rows = persist_spread(_source(train, id_col, treatment, outcome, features))
    lists = _Lists(rows, len(features))
    like: dict[CausalTreeParams, list[CausalTreeParams]] = {}
    for p in grid.values():
        like.setdefault(replace(p, max_depth=None, trees=1), []).append(p)
    slots = []
    for kind, some in like.items():
        depth = None if any(p.max_depth is None for p in some) else max(p.max_depth for p in some)
        slots += [_Slot(kind, i, replace(kind, max_depth=depth)) for i in range(max(p.trees for p in some))]
    grown: dict[CausalTreeParams, list[list[TreeNode]]] = {kind: [] for kind in like}
    try:
        for first in range(0, len(slots), trees_per_pass):
            some = slots[first:first + trees_per_pass]
            _Grower(rows, lists, some).grow()
            for slot in some:
                grown[slot.kind].append(slot.nodes)
    finally:
        lists.unpersist()
    fitted = {
        name: [TreeTables(features, _cut_off(nodes, p.max_depth), digits=4)
               for nodes in grown[replace(p, max_depth=None, trees=1)][:p.trees]]
        for name, p in grid.items()}
    return {
        name: CausalForestModel(features, fitted[name], grid[name], _importances(fitted[name]))
        for name in grid
    }


def _importances(trees: list[TreeTables]) -> dict[int, float]:
    """Credited impurity decrease per feature, normalised per tree and averaged."""
    out: dict[int, float] = {}
    for tree in trees:
        total = sum(n.credit for n in tree.nodes)
        for n in tree.nodes:
            if not n.is_leaf and total:
                out[n.feature] = out.get(n.feature, 0.0) + n.credit / total / len(trees)
    return out


def fit_causal_tree(train, id_col, treatment, outcome, features, params: CausalTreeParams) -> CausalForestModel:
    return fit_grid(train, id_col, treatment, outcome, features, {"tree": params})["tree"]


def _dealt(df: DataFrame, trees: int) -> DataFrame:
    return spread(df) if trees >= MANY_TREES else df


def _with_features(df: DataFrame, features: list) -> tuple[DataFrame, str]:
    """``df`` with the features as an array of doubles in a column of a free name."""
    name = "_x"
    while name in df.columns:
        name += "_"
    return df.select("*", F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias(name)), name


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(column.flatten(), np.nan), dtype=np.float64).reshape(rows, -1)


def predict_grid(df: DataFrame, models: dict[str, CausalForestModel]) -> DataFrame:
    """One effect column per fitted configuration, all in one pass over the rows."""
    if not models:
        return df
    features = list(dict.fromkeys(f for m in models.values() for f in m.features))
    wide, x_name = _with_features(_dealt(df, sum(len(m.trees) for m in models.values())), features)
    fitted = {
        name: (*m.arrays(), np.array([features.index(f) for f in m.features])) for name, m in models.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(x_name), batch.num_rows)
            columns = {c: batch.column(c) for c in batch.schema.names if c != x_name}
            for name, (trees, values, use) in fitted.items():
                step = max(1, presorted.CELLS // len(trees.roots))
                parts = [
                    values[presorted.route(trees, x[low:low + step][:, use])].mean(axis=0)
                    for low in range(0, batch.num_rows, step)]
                columns[name] = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in models]])
    return wide.mapInArrow(score, schema)


def tree_node_report(
    tree: TreeTables, train: DataFrame, test: DataFrame, treatment: str, outcome: str, binary: bool = True
) -> DataFrame:
    """Every node with shares and effects on both samples and its training p-value."""
    arm = F.when(F.col(treatment) > 0, 1).otherwise(0)
    spark = train.sparkSession
    fitted = tree.node_moments(train, arm, outcome, 2)
    held = tree.node_moments(test, arm, outcome, 2)
    on_train = node_shares(fitted).join(
        fitted.select("node_id", node_p_value(binary).alias("p_value")), "node_id"
    )
    on_test = node_shares(held)
    names = ("num_t", "num_c", "share_t", "share_c", "share", "uplift")
    return (
        tree.structure_frame(spark)
        .join(on_train.withColumnsRenamed({c: f"{c}_train" for c in names}), "node_id", "left")
        .join(on_test.withColumnsRenamed({c: f"{c}_test" for c in names}), "node_id", "left")
    )


def tree_leaf_report(
    tree: TreeTables, train: DataFrame, test: DataFrame, treatment: str, outcome: str, binary: bool = True
) -> DataFrame:
    """Leaves by falling test effect: path, p, effects and test sums and counts."""
    spark = train.sparkSession
    fitted = group_effect_stats(tree.route(train), "leaf_id", treatment, outcome, binary).select(
        "leaf_id", "p_value", F.col("uplift").alias("uplift_train")
    )
    held = group_effect_stats(tree.route(test), "leaf_id", treatment, outcome, binary).select(
        "leaf_id", F.col("uplift").alias("uplift_test"), *[
            F.col(c).alias(f"{c}_test") for c in ("sum_t", "sum_c", "num_t", "num_c")
        ]
    )
    leaves = tree.structure_frame(spark).where("is_leaf").select(F.col("node_id").alias("leaf_id"), "path")
    return (
        leaves.join(fitted, "leaf_id", "left").join(held, "leaf_id", "left")
        .select("path", "p_value", "uplift_train", "uplift_test",
                "sum_t_test", "sum_c_test", "num_t_test", "num_c_test")
        .orderBy(F.desc_nulls_last("uplift_test"), "path")
    )


def causal_tree_report(
    df: DataFrame, id_col: str, treatment: str, outcome: str, features, train_flag: str | None = None,
    binary: bool = True, max_depth: int = 5, min_leaf_share: float = 0.01, seed: int = 25,
    criterion: str = "causal_mse",
) -> tuple[CausalForestModel, DataFrame, DataFrame]:
    """Split, fit one tree and report its leaves and nodes on both samples."""
    train, test = split_by_flag(df, train_flag, id_col, 0.8, seed)
    rows = train.count()
    params = CausalTreeParams(
        criterion=criterion, max_depth=max_depth, min_samples_leaf=max(1, int(rows * min_leaf_share))
    )
    model = fit_causal_tree(train, id_col, treatment, outcome, features, params)
    tree = model.trees[0]
    leaf = tree_leaf_report(tree, train, test, treatment, outcome, binary)
    node = tree_node_report(tree, train, test, treatment, outcome, binary)
    return model, leaf, node


def leaf_prediction_values(model: CausalForestModel, df: DataFrame) -> DataFrame:
    """How many rows of ``df`` get each leaf value, per tree of the model."""
    wide, x_name = _with_features(_dealt(df, len(model.trees)), model.features)
    trees, values = model.arrays()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(values), dtype=np.int64)
        step = max(1, presorted.CELLS // len(trees.roots))
        for batch in batches:
            x = _matrix(batch.column(x_name), batch.num_rows)
            for low in range(0, batch.num_rows, step):
                total += np.bincount(presorted.route(trees, x[low:low + step]).ravel(), minlength=len(values))
        used = np.flatnonzero(total)
        tree = np.searchsorted(trees.roots, used, side="right") - 1
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array(tree, pa.int32()), "leaf_id": pa.array(used - trees.roots[tree], pa.int32()),
            "value": pa.array(values[used]), "n": pa.array(total[used])})

    found = wide.select(x_name).mapInArrow(count, "tree int, leaf_id int, value double, n long")
    return found.groupBy("tree", "leaf_id", "value").agg(F.sum("n").alias("n"))
