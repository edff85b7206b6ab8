"""Exact split search over presorted feature lists.

Every row is written once for each feature, sorted by that feature over all partitions
and carrying all features, so that a task can send its rows through the trees by itself:
no row moves after that. A level is two scans. The first sums each partition's rows per
node; windows over these small tables give what lies before each partition and the next
value behind it. The second walks the partitions from there, so every threshold between
two neighbouring values of a node is tried, and yields the best one for each node and
partition. All trees of a pass share both scans.

A list is sorted by (value, row hash): rows that share a value spread over partitions, and
no threshold falls among them. Missing values are in no list of their feature; as they
fail every test they count to the right.

Features of few values need no list: a scan sums their rows by node and value. Nodes of
up to ``LOCAL_ROWS`` rows are not scanned either: their rows are brought together, one
group a node, and :func:`subtrees` splits them to the end by the same search in a task.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.session import checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Per arm rows, sum and sum of squares: treated first.
STATS = ("nt", "st", "qt", "nc", "sc", "qc")
#: Cells of (tree, row) that a task works on at once.
CELLS = 1 << 15
#: Cells of (partition, node) whose offsets a scan takes along, 64 bytes each.
OFFSETS = 1 << 20
#: Rows of a node, copies counted, up to which one task splits it to the end.
LOCAL_ROWS = 1 << 22
#: How many times ``LOCAL_ROWS`` a whole tree may have, drawn rows counted once, for a task that reads them by itself.
WHOLE = 3
#: Nodes of finished trees, about 70 bytes each, that come to the driver at once.
NODES = 1 << 23
#: Rows of a subtree that are searched at once.
PIECE = 1 << 15
#: Rows of a node from which on runs of values are summed before single ones are tried.
BULK = 1 << 12
#: Runs of values for each feature of such a node, as a multiple of the root of its rows.
RUNS = 8
#: Rows of such a node that are summed at once.
CHUNK = 1 << 17
#: Cells of (tree, row) whose rows are packed at once on the way to their subtrees.
PACK = 1 << 20
#: Distinct values up to which a feature is summed by value instead of sorted.
FEW = 64
CRITERIA = ("standard_mse", "causal_mse", "t_test")


@dataclass
class Frontier:
    """Nodes to split in one scan, with the trees that lead to them.

    ``trees`` numbers the trees (for their weights) and ``roots`` points into the flat
    node arrays; ``slot`` is a node's place among those to split, else -1.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    slot: np.ndarray
    trees: np.ndarray
    roots: np.ndarray
    depth: int
    seeds: np.ndarray
    bootstrap: np.ndarray
    stats: np.ndarray | None = None
    code: np.ndarray | None = None
    penalty: np.ndarray | None = None
    min_leaf: np.ndarray | None = None
    min_drop: np.ndarray | None = None
    total: np.ndarray | None = None
    levels: np.ndarray | None = None


def route(f: Frontier, x: np.ndarray) -> np.ndarray:
    """(trees, rows) node reached by every row in every tree."""
    rows, width = x.shape
    flat = np.ascontiguousarray(x).ravel()
    # A leaf leads to itself on both sides, so every step is the same few look-ups.
    own = np.arange(len(f.feature), dtype=np.int32)
    leaf = f.feature < 0
    child = np.stack((np.where(leaf, own, f.right), np.where(leaf, own, f.left)), 1).astype(np.int32).ravel()
    feature = np.maximum(f.feature, 0).astype(np.int32)
    at = np.repeat(f.roots.astype(np.int32)[:, None], rows, axis=1).ravel()
    base = np.tile((np.arange(rows, dtype=np.int32) * width), len(f.roots))
    out, live = at, None
    for level in range(f.depth):
        value = flat.take(base + feature.take(at))
        goes = value <= f.threshold.take(at)
        at = child.take(2 * at + goes)
        if level % 4 == 3:
            # Most rows are in leaves long before the deepest ones.
            if live is None:
                out, live = at, np.arange(len(at), dtype=np.int32)
            else:
                out[live] = at
            more = np.flatnonzero(~leaf.take(at))
            live, at, base = live.take(more), at.take(more), base.take(more)
            if not len(more):
                break
    if live is None:
        out = at
    else:
        out[live] = at
    return out.reshape(len(f.roots), rows)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_UPTO = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(13)])


def weights(f: Frontier, h: np.ndarray) -> np.ndarray:
    """(trees, rows) copies of a row: Poisson(1) from a hash of row, seed and tree, or one."""
    if not f.bootstrap.any():
        return np.ones((len(f.trees), len(h)))
    salt = _mixed(f.seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + f.trees.astype(np.uint64) + np.uint64(1))
    u = (_mixed(h.astype(np.int64).view(np.uint64)[None, :] ^ salt[:, None]) >> np.uint64(11)) / float(1 << 53)
    drawn = np.searchsorted(_UPTO, u, side="right").astype(np.float64)
    return np.where(f.bootstrap[:, None], drawn, 1.0)


def _impurity(code, s, penalty):
    nt, st, qt, nc, sc, qc = s
    n = nt + nc
    out = None
    if np.any(code == 0):
        mean = (st + sc) / n
        out = np.maximum((qt + qc) / n - mean * mean, 0.0)
    if np.any(code != 0):
        error, tau = _error(s)
        causal = error - tau * tau
        out = causal if out is None else np.where(code == 0, out, causal)
    return out + penalty * np.abs(nt - nc) / n if np.any(penalty) else out


def _error(s):
    """(sampling variance, value) of the effect from a side's statistics."""
    nt, st, qt, nc, sc, qc = s
    m_t, m_c = st / nt, sc / nc
    v_t = np.maximum(qt / nt - m_t * m_t, 0.0)
    v_c = np.maximum(qc / nc - m_c * m_c, 0.0)
    return v_t / nt + v_c / nc, m_t - m_c


def _gain(code, penalty, whole, own, left):
    """Gain of splits by (statistics, splits) of their nodes and left sides; ``own`` is the nodes' impurity."""
    right = whole - left
    n_l, n_r = left[0] + left[3], right[0] + right[3]
    n = n_l + n_r
    with np.errstate(all="ignore"):
        drop = squared = None
        if np.any(code != 2):
            drop = own - n_l / n * _impurity(code, left, penalty) - n_r / n * _impurity(code, right, penalty)
        if np.any(code == 2):
            (e_l, t_l), (e_r, t_r) = _error(left), _error(right)
            squared = (t_l - t_r) ** 2 / (e_l + e_r)
            squared = np.where(np.isfinite(squared), squared, np.nan)
    if drop is None or squared is None:
        return squared if drop is None else drop
    return np.where(code == 2, squared, drop)


def gains(f: Frontier, a: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Gain of splits of the nodes in slots ``a`` by their left sides; nan where not allowed.

    ``standard_mse`` drops the outcome variance, ``causal_mse`` the estimated error of the
    effect (its sampling variance less its square), each plus ``penalty`` times the arms'
    imbalance share; ``t_test`` is the squared t of the children's effects.
    """
    whole = f.stats[a]
    right = whole - left
    n_l, n_r = left[:, 0] + left[:, 3], right[:, 0] + right[:, 3]
    fits = (np.minimum(n_l, n_r) >= f.min_leaf[a]) & (
        np.minimum(np.minimum(left[:, 0], left[:, 3]), np.minimum(right[:, 0], right[:, 3])) >= 1)
    out = np.full(len(a), np.nan)
    at = np.flatnonzero(fits)
    if not len(at):
        return out
    whole, left, code, penalty = whole[at].T, left[at].T, f.code[a[at]], f.penalty[a[at]]
    with np.errstate(all="ignore"):
        own = _impurity(code, whole, penalty)
    out[at] = _gain(code, penalty, whole, own, left)
    return out


def feature_lists(rows: DataFrame, features: int, only: list[int] | None = None) -> DataFrame:
    """(part, f, h, t, y, x0, x1, ...): the rows of (h, t, y, x0, ...) once a feature, globally sorted.

    ``only`` names the features that get a list, all if not given.

    Written to the checkpoint folder, since the bounds of the partitions are drawn anew
    in every run, and kept in memory as far as it goes.
    """
    x = [f"x{i}" for i in range(features)]
    own = range(features) if only is None else only
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(x[i]).alias("v")) for i in own])
    each = rows.select("*", F.inline(pairs)).where("v IS NOT NULL AND NOT isnan(v)")
    order = [F.col("f"), F.col("v"), F.col("h")]
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = each.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return checkpoint(ranged.withColumn("part", F.spark_partition_id()).select("part", "f", "h", "t", "y", *x)).persist()


def few_values(rows: DataFrame, features: int) -> dict[int, np.ndarray]:
    """The features with at most ``FEW`` distinct values, and these values in order."""
    x = [f"x{i}" for i in range(features)]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros(0)] * features
        for batch in batches:
            for i, c in enumerate(x):
                if len(seen[i]) <= FEW:
                    v = np.asarray(batch.column(c), dtype=np.float64)
                    seen[i] = np.unique(np.concatenate((seen[i], v[~np.isnan(v)])))[:FEW + 1]
        yield pa.RecordBatch.from_pydict({
            "f": pa.array(np.repeat(np.arange(features), [len(v) for v in seen]), pa.int32()),
            "v": pa.array(np.concatenate(seen))})

    values: dict[int, list[float]] = {i: [] for i in range(features)}
    for r in rows.mapInArrow(distinct, "f int, v double").groupBy("f").agg(
            F.slice(F.sort_array(F.collect_set("v")), 1, FEW + 1).alias("v")).collect():
        values[r["f"]] = r["v"]
    return {i: np.array(v, dtype=np.float64) for i, v in values.items() if len(v) <= FEW}


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    x = [c for c in batch.schema.names if c.startswith("x")]
    out = {c: np.asarray(batch.column(c)) for c in batch.schema.names if c not in x}
    # Nulls become nan on the way to numpy.
    out["x"] = np.stack([np.asarray(batch.column(c), dtype=np.float64) for c in x], 1)
    if "f" in out:
        out["v"] = out["x"][np.arange(batch.num_rows), out["f"]]
    return out


def _pieces(batches: Iterator[pa.RecordBatch], trees: int, cells: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows of one feature with at most ``cells`` (``CELLS`` unless given) cells of (tree, row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = _columns(batch)
        f = data.get("f", np.zeros(batch.num_rows, np.int32))
        edges = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1], [True])))
        step = max(1, (cells or CELLS) // max(1, trees))
        for low, high in zip(edges, edges[1:]):
            for first in range(low, high, step):
                yield {c: v[first:min(high, first + step)] for c, v in data.items()}


def _active(f: Frontier, data: dict[str, np.ndarray]):
    """(slot, row, statistics) of the cells in nodes to split, in slot order, rows kept in order."""
    rows = len(data["h"])
    slot = f.slot.take(route(f, data["x"]).ravel())
    w = weights(f, data["h"]).ravel()
    at = np.flatnonzero((slot >= 0) & (w > 0))
    slot = slot.take(at)
    # Numpy sorts numbers of 16 bits by counting.
    order = np.argsort(slot.astype(np.int16) if len(slot) and slot.max() < 1 << 15 else slot, kind="stable")
    at = at.take(order)
    row, w = at % rows, w.take(at)
    t, y = data["t"].astype(np.float64).take(row), data["y"].take(row)
    wt, wc = w * t, w * (1 - t)
    return slot.take(order), row, np.stack((wt, wt * y, wt * y * y, wc, wc * y, wc * y * y), 1)


def _sums(a: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(a, values[:, j], n) for j in range(values.shape[1])], 1)


STATS_SCHEMA = ", ".join(f"{c} double" for c in STATS)


def node_totals(rows: DataFrame, f: Frontier) -> np.ndarray:
    """Statistics of the frontier's nodes over ``rows`` of (h, t, y, x0, ...)."""
    n = int(f.slot.max()) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, 6))
        for data in _pieces(batches, len(f.roots)):
            a, _, s = _active(f, data)
            total += _sums(a, s, n)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(used, pa.int32()), **{c: pa.array(total[used, j]) for j, c in enumerate(STATS)}})

    sums = rows.mapInArrow(add, f"a int, {STATS_SCHEMA}").groupBy("a").agg(*[F.sum(c).alias(c) for c in STATS])
    out = np.zeros((n, 6))
    for r in sums.collect():
        out[r["a"]] = [r[c] for c in STATS]
    return out


def _offsets(lists: DataFrame, f: Frontier) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    """Per (partition, feature): slots, statistics of earlier partitions, next value behind it."""
    n = len(f.stats)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for data in _pieces(batches, len(f.roots)):
            key = int(data["part"][0]), int(data["f"][0])
            a, row, s = _active(f, data)
            if key not in found:
                found[key] = [np.zeros((n, 6)), np.full(n, np.inf)]
            total, low = found[key]
            total += _sums(a, s, n)
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
            low[a[first]] = np.minimum(low[a[first]], data["v"][row[first]])
        for (part, feature), (total, low) in found.items():
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(used), part), pa.int32()), "f": pa.array(np.full(len(used), feature), pa.int32()),
                "a": pa.array(used, pa.int32()), "low": pa.array(low[used]),
                **{c: pa.array(total[used, j]) for j, c in enumerate(STATS)}})

    totals = lists.mapInArrow(add, f"part int, f int, a int, low double, {STATS_SCHEMA}")
    node = Window.partitionBy("f", "a").orderBy("part")
    before = node.rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.select(
        "part", "f", "a", F.lead("low").over(node).alias("next"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in STATS])
    out = {}
    table = rows.toArrow()
    part, feature, slot = (np.asarray(table.column(c)) for c in ("part", "f", "a"))
    behind = np.asarray(pa.compute.fill_null(table.column("next"), np.nan))
    sums = np.stack([np.asarray(table.column(c)) for c in STATS], 1) if table.num_rows else np.zeros((0, 6))
    order = np.lexsort((slot, feature, part))
    edges = np.flatnonzero(np.concatenate((
        [True], (part[order][1:] != part[order][:-1]) | (feature[order][1:] != feature[order][:-1]), [True]))) if len(order) else []
    for low, high in zip(edges, edges[1:]):
        at = order[low:high]
        out[int(part[at[0]]), int(feature[at[0]])] = slot[at], sums[at], behind[at]
    return out


def _between(v: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A threshold that sends ``v`` left and ``after`` right."""
    with np.errstate(all="ignore"):
        middle = v + (after - v) / 2
    return np.where((middle >= v) & (middle < after), middle, v)


class _Walk:
    """One partition's rows of one feature in order: sums so far, and each node's last value."""

    def __init__(self, f: Frontier, offsets):
        n = len(f.stats)
        self.f, self.sums, self.last = f, np.zeros((n, 6)), np.full(n, np.nan)
        self.behind = np.full(n, np.nan)
        if offsets is not None:
            slots, before, behind = offsets
            self.sums[slots], self.behind[slots] = before, behind

    def step(self, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, left statistics, threshold) of the candidates that end before or in ``data``."""
        a, row, s = _active(self.f, data)
        if not len(a):
            return np.zeros(0, np.int64), np.zeros((0, 6)), np.zeros(0)
        v = data["v"][row]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        size = np.diff(np.append(first, len(a)))
        upto = np.cumsum(s, axis=0)
        before = np.concatenate((np.zeros((1, 6)), upto))[first]
        left = upto - np.repeat(before - self.sums[a[first]], size, axis=0)
        inner = np.flatnonzero((a[1:] == a[:-1]) & (v[1:] > v[:-1]))
        nodes, end = a[first], first + size - 1
        open_ = np.flatnonzero(v[first] > self.last[nodes])
        found = (
            np.concatenate((nodes[open_], a[inner])),
            np.concatenate((self.sums[nodes[open_]], left[inner])),
            np.concatenate((_between(self.last[nodes[open_]], v[first[open_]]), _between(v[inner], v[inner + 1]))))
        self.sums[nodes], self.last[nodes] = left[end], v[end]
        return found

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates between the last values here and the next ones in later partitions."""
        a = np.flatnonzero(self.behind > self.last)
        return a, self.sums[a], _between(self.last[a], self.behind[a])


def _walk(batches, f: Frontier, offsets) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, slots, left statistics, thresholds) of all candidates of a partition."""
    walk, key = None, None
    for data in _pieces(batches, len(f.roots)):
        here = int(data["part"][0]), int(data["f"][0])
        if here != key:
            if walk is not None:
                yield (key[1], *walk.finish())
            walk, key = _Walk(f, offsets.get(here)), here
        yield (key[1], *walk.step(data))
    if walk is not None:
        yield (key[1], *walk.finish())


def _scan(lists: DataFrame, f: Frontier, task: Callable, schema: str) -> DataFrame:
    offsets = lists.sparkSession.sparkContext.broadcast(_offsets(lists, f))
    return lists.mapInArrow(lambda batches: task(_walk(batches, f, offsets.value)), schema)


def all_splits(lists: DataFrame, f: Frontier) -> DataFrame:
    """Every allowed split: a, f, threshold, gain, n_left, n_right."""

    def task(found) -> Iterator[pa.RecordBatch]:
        for feature, a, left, threshold in found:
            gain = gains(f, a, left)
            at = np.flatnonzero(~np.isnan(gain))
            n_left, whole = left[at][:, [0, 3]].sum(1), f.stats[a[at]][:, [0, 3]].sum(1)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(a[at], pa.int32()), "f": pa.array(np.full(len(at), feature), pa.int32()),
                "threshold": pa.array(threshold[at]), "gain": pa.array(gain[at]),
                "n_left": pa.array(n_left.astype(np.int64)), "n_right": pa.array((whole - n_left).astype(np.int64))})

    return _scan(lists, f, task, "a int, f int, threshold double, gain double, n_left long, n_right long")


SPLIT_SCHEMA = f"a int, loss double, f int, threshold double, credit double, {STATS_SCHEMA}"


def _splits_by_value(rows: DataFrame, f: Frontier, few: dict[int, np.ndarray]) -> DataFrame:
    """The best split of each node on features of few values, from sums by node and value."""
    n = len(f.stats)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((n * len(v), 6)) for i, v in few.items()}
        for data in _pieces(batches, len(f.roots)):
            a, row, s = _active(f, data)
            for i, values in few.items():
                v = data["x"][row, i]
                at = np.flatnonzero(~np.isnan(v))
                total[i] += _sums(a[at] * len(values) + np.searchsorted(values, v[at]), s[at], n * len(values))
        for i, values in few.items():
            used = np.flatnonzero(total[i].any(axis=1))
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(used // len(values), pa.int32()), "f": pa.array(np.full(len(used), i), pa.int32()),
                "v": pa.array(values[used % len(values)]),
                **{c: pa.array(total[i][used, j]) for j, c in enumerate(STATS)}})

    def best(table: pa.Table) -> pa.Table:
        a, feature, v = (np.asarray(table.column(c)) for c in ("a", "f", "v"))
        order = np.lexsort((v, feature))
        a, feature, v = a[order], feature[order], v[order]
        upto = np.stack([np.asarray(table.column(c))[order] for c in STATS], 1).cumsum(axis=0)
        first = np.searchsorted(feature, feature)
        left = upto - np.where((first > 0)[:, None], upto[first - 1], 0.0)
        at = np.flatnonzero(feature[1:] == feature[:-1])
        gain = gains(f, a[at], left[at])
        credit = f.stats[a[at]][:, [0, 3]].sum(1) / f.total[a[at]] * gain
        loss, threshold = -np.round(gain, 12), _between(v[at], v[at + 1])
        use = np.flatnonzero((loss < 0) & (credit >= f.min_drop[a[at]]))
        use = use[np.lexsort((threshold[use], feature[at][use], loss[use]))][:1]
        return pa.Table.from_pydict({
            "a": pa.array(a[at][use], pa.int32()), "loss": pa.array(loss[use]), "f": pa.array(feature[at][use], pa.int32()),
            "threshold": pa.array(threshold[use]), "credit": pa.array(credit[use]),
            **{c: pa.array(left[at][use, j]) for j, c in enumerate(STATS)}})

    sums = rows.mapInArrow(add, f"a int, f int, v double, {STATS_SCHEMA}").groupBy("a", "f", "v").agg(
        *[F.sum(c).alias(c) for c in STATS])
    return sums.groupBy("a").applyInArrow(best, SPLIT_SCHEMA)


def best_splits(
    lists: DataFrame | None, f: Frontier, rows: DataFrame | None = None, few: dict[int, np.ndarray] | None = None
) -> DataFrame:
    """The best split of each node that gains: a, loss, f, threshold, credit and its left side.

    Equal gains, to 12 digits, go to the first feature and the lowest threshold.
    """
    each = None if lists is None else _splits_by_list(lists, f)
    if few:
        by_value = _splits_by_value(rows, f, few)
        each = by_value if each is None else each.unionByName(by_value)
    return each.groupBy("a").agg(F.min(F.struct("loss", "f", "threshold", "credit", *STATS)).alias("b")).select("a", "b.*")


def _splits_by_list(lists: DataFrame, f: Frontier) -> DataFrame:
    """The best splits of each node by feature and partition of the lists."""
    n = len(f.stats)

    def task(found) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for feature, a, left, threshold in found:
            gain = gains(f, a, left)
            credit = f.stats[a][:, [0, 3]].sum(1) / f.total[a] * gain
            loss = -np.round(gain, 12)
            at = np.flatnonzero((loss < 0) & (credit >= f.min_drop[a]))
            if not len(at):
                continue
            at = at[np.lexsort((threshold[at], loss[at], a[at]))]
            at = at[np.concatenate(([True], a[at][1:] != a[at][:-1]))]
            own = best.setdefault(feature, [np.full(n, np.inf), np.zeros(n), np.zeros(n), np.zeros((n, 6))])
            at = at[loss[at] < own[0][a[at]]]
            for place, value in enumerate((loss, threshold, credit, left)):
                own[place][a[at]] = value[at]
        for feature, (loss, threshold, credit, left) in best.items():
            used = np.flatnonzero(np.isfinite(loss))
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(used, pa.int32()), "loss": pa.array(loss[used]), "f": pa.array(np.full(len(used), feature), pa.int32()),
                "threshold": pa.array(threshold[used]), "credit": pa.array(credit[used]),
                **{c: pa.array(left[used, j]) for j, c in enumerate(STATS)}})

    return _scan(lists, f, task, SPLIT_SCHEMA)


#: A node of a finished subtree: its number there (0 the top) and, if split, its children's.
SUBTREE_SCHEMA = f"a int, node int, f int, threshold double, credit double, left int, {STATS_SCHEMA}"


def subtrees(rows: DataFrame, f: Frontier) -> DataFrame:
    """The frontier's nodes split to the end, each in one task from its own rows only.

    The right child's number is the left one's plus one.
    """
    width = len([c for c in rows.columns if c.startswith("x")])
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _pieces(batches, len(f.roots), PACK):
            count = len(data["h"])
            slot = f.slot.take(route(f, data["x"]).ravel())
            copies = weights(f, data["h"]).astype(np.int8).ravel()
            signed = np.where(np.tile(data["t"], len(f.roots)) > 0, copies, -copies)
            at = np.flatnonzero((slot >= 0) & (copies > 0))
            at = at[np.argsort(slot[at], kind="stable")]
            if not len(at):
                continue
            slot, row, signed = slot[at], at % count, signed[at]
            wide = np.concatenate((data["x"], data["y"].astype(np.float64)[:, None]), 1)
            edges = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True])))
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(slot[edges[:-1]], pa.int32()),
                "x": pa.array([wide[row[i:j]].tobytes() for i, j in zip(edges, edges[1:])], pa.binary()),
                "w": pa.array([signed[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())})

    def grow(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        wide = np.concatenate([
            np.frombuffer(b.as_buffer(), np.float64) for b in table.column("x")]).reshape(-1, width + 1)
        signed = np.concatenate([np.frombuffer(b.as_buffer(), np.int8) for b in table.column("w")])
        codes, values = zip(*[ranks(wide[:, j]) for j in range(width)])
        return _Subtree(f, a, f.stats[a]).grow([*codes], [*values], wide[:, width].copy(), signed)

    packed = rows.mapInArrow(deal, "a int, x binary, w binary")
    # Groups take seconds each: with more partitions than groups few share a task.
    parts = max(parts, min(2 * (int(f.slot.max()) + 1), 4 * parts))
    return packed.repartition(parts, "a").groupBy("a").applyInArrow(grow, SUBTREE_SCHEMA)


def _moments(y: np.ndarray, signed: np.ndarray) -> np.ndarray:
    """Copies, sums and squares of rows, treated ones real and controls imaginary."""
    w = np.where(signed > 0, signed, 1j * np.abs(signed))
    return np.stack((w, w * y, w * y * y))


@dataclass
class _Part:
    """Nodes of one level side by side: rows in node order, and each feature's order inside the nodes.

    ``s`` are copies, sums and squares of the rows, treated ones real and controls imaginary.
    """

    ids: np.ndarray
    stats: np.ndarray
    levels: float
    slot: np.ndarray
    x: np.ndarray
    s: np.ndarray
    orders: list[np.ndarray]


def row_blocks(rows: DataFrame, few: dict[int, np.ndarray]) -> RDD:
    """The rows of (h, t, y, x0, ...) as pickled (h, t, y, [x0, ...]) of many rows each, features of few values as ranks."""
    width = len([c for c in rows.columns if c.startswith("x")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _pieces(batches, 1):
            x = [np.searchsorted(few[j], data["x"][:, j]).astype(np.uint8) if j in few else data["x"][:, j].copy()
                 for j in range(width)]
            block = pickle.dumps((data["h"], data["t"].astype(np.int8), data["y"].astype(np.float64), x), protocol=5)
            yield pa.RecordBatch.from_pydict({"b": pa.array([block], pa.binary())})

    return rows.mapInArrow(pack, "b binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def whole_trees(blocks: RDD, width: int, f: Frontier, few: dict[int, np.ndarray]) -> list[pa.Table]:
    """The frontier's trees of one node each grown by a task that reads all rows; root first, statistics included."""

    def grow(number: int, read: Iterator[bytes]) -> Iterator[bytes]:
        own = replace(f, trees=f.trees[number:number + 1], seeds=f.seeds[number:number + 1], bootstrap=f.bootstrap[number:number + 1])
        ys, signs, xs = [], [], []
        for block in read:
            h, t, y, x = pickle.loads(block)
            copies = weights(own, h)[0].astype(np.int8)
            at = np.flatnonzero(copies)
            copies = copies.take(at)
            signs.append(np.where(t.take(at) > 0, copies, -copies))
            ys.append(y.take(at))
            xs.append([v.take(at) for v in x])
        if not xs:
            ys, signs, xs = [np.zeros(0)], [np.zeros(0, np.int8)], [[np.zeros(0, np.uint8 if j in few else float) for j in range(width)]]
        y, signed = np.concatenate(ys), np.concatenate(signs)
        del ys, signs
        codes, values = [], []
        for j in range(width):
            v = np.concatenate([x[j] for x in xs])
            for x in xs:
                x[j] = None
            code, distinct = (v, few[j]) if j in few else ranks(v)
            codes.append(code)
            values.append(distinct)
        del v, xs
        top = np.zeros(6)
        for low in range(0, len(y), CHUNK):
            part = _moments(y[low:low + CHUNK], signed[low:low + CHUNK]).sum(axis=1)
            top += np.concatenate((part.real, part.imag))
        tree = _Subtree(f, number, top, max(1.0, top[0] + top[3])).grow(codes, values, y, signed)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, tree.schema) as out:
            out.write_table(tree)
        yield sink.getvalue().to_pybytes()

    one = blocks.coalesce(1)
    found = blocks.context.union([one] * len(f.trees)).mapPartitionsWithIndex(grow).collect()
    return [pa.ipc.open_stream(t).read_all() for t in found]


@dataclass
class _Bulk:
    """A node of many rows: ranks of its values by feature, outcomes, and copies (negative for controls).

    ``low`` and ``high`` bound each feature's ranks here; missing values have the rank after the last.
    Rows of no copies have gone to other nodes, since ``runs``, sums by run of ranks, were made.
    """

    id: int
    stats: np.ndarray
    levels: float
    codes: list[np.ndarray]
    y: np.ndarray
    signed: np.ndarray
    low: list[int]
    high: list[int]
    rows: int
    runs: _Runs | None = None


@dataclass
class _Runs:
    """Sums by run of a node's ranks: ranks less ``base`` without their last ``shift`` bits.

    The last of ``size`` runs is for missing values; ``rows`` is how many the node had that the runs were made for.
    """

    rows: int
    base: list[int]
    shift: list[int]
    size: list[int]
    sums: list[np.ndarray]


def ranks(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every value's place among the distinct ones, and these in order; missing values come after them."""
    order = np.argsort(v)
    v = v.take(order)
    real = len(v) - int(np.isnan(v).sum())
    first = np.empty(len(v), bool)
    first[:1], first[real:] = True, False
    np.not_equal(v[1:real], v[:real - 1], out=first[1:real])
    values = v[:real][first[:real]]
    place = np.cumsum(first, dtype=np.int32)
    place -= 1
    place[real:] = len(values)
    kind = np.uint8 if len(values) < 1 << 8 else np.uint16 if len(values) < 1 << 16 else np.int32
    code = np.empty(len(v), kind)
    code[order] = place
    return code, values


def _means(base: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the mean of ``base`` and any part of ``inner``, each (rows, sum, squares).

    Parts of k values with spread d differ from their share of the sum by k d / 2 at most.
    """
    n, s, _ = base
    k, si, qi = inner
    mean = np.divide(si, k, out=np.zeros_like(si), where=k > 0)
    wide = np.sqrt(np.maximum(qi * k - si * si, 0.0)) / 2
    few, many = np.maximum(n, 1.0), np.maximum(n + k, 1.0)
    above, below = s - mean * n + wide, s - mean * n - wide
    return (mean + below / np.where(below > 0, many, few), mean + above / np.where(above > 0, few, many))


def _spread(s: np.ndarray) -> np.ndarray:
    """Sum of squares about the mean of (rows, sum, squares); no more rows can lower it."""
    return np.maximum(s[2] - np.divide(s[1] * s[1], s[0], out=np.zeros_like(s[1]), where=s[0] > 0), 0.0)


def _most(low, high, share_low, share_high):
    """The largest product of a value and a share within their bounds."""
    return np.where(high > 0, high * share_high, high * share_low)


def gain_bounds(code: int, penalty: float, whole: np.ndarray, own, before: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """No split inside a run of values gains more than this, by statistics before and in the runs.

    ``whole`` is (6, 1); ``before`` and ``inner`` are (6, runs). Means lie within ``_means`` and
    squares about them never fall below those of the rows that are on a side in any case.
    """
    after = whole - before - inner
    n = whole[0] + whole[3]
    n_l, n_r, k = before[0] + before[3], after[0] + after[3], inner[0] + inner[3]
    with np.errstate(all="ignore"):
        if code == 0:
            pooled = [x[:3] + x[3:] for x in (before, after, inner)]
            (low_l, high_l), (low_r, high_r) = _means(pooled[0], pooled[2]), _means(pooled[1], pooled[2])
            gap = np.maximum(high_l - low_r, high_r - low_l)
            middle = np.clip(n / 2, n_l, n_l + k)
            most = middle * (n - middle) / (n * n) * gap * gap
        else:
            sides = []
            for base in (before, after):
                (low_t, high_t), (low_c, high_c) = _means(base[:3], inner[:3]), _means(base[3:], inner[3:])
                error = (_spread(base[:3]) / np.maximum(base[0] + inner[0], 1.0) ** 2
                         + _spread(base[3:]) / np.maximum(base[3] + inner[3], 1.0) ** 2)
                sides.append((low_t - high_c, high_t - low_c, error))
            (low_l, high_l, e_l), (low_r, high_r, e_r) = sides
            if code == 2:
                gap = np.maximum(high_l - low_r, high_r - low_l)
                most = gap * gap / (e_l + e_r)
            else:
                error, effect = _error(whole)
                most = error - n_l / n * e_l - n_r / n * e_r
                for low, high, few in ((low_l, high_l, n_l), (low_r, high_r, n_r)):
                    low, high = low - effect, high - effect
                    # d (2 effect + d) is largest at an end.
                    worth = np.maximum(low * (2 * effect + low), high * (2 * effect + high))
                    most = most + _most(None, worth, few / n, (few + k) / n)
        if penalty and code != 2:
            alike = np.abs(whole[0] - whole[3]) / n
            for base in (before, after):
                low, high = base[0] - base[3] - inner[3], base[0] + inner[0] - base[3]
                alike = alike - np.maximum(np.maximum(low, -high), 0.0) / n
            most = most + penalty * alike
    return most


class _Subtree:
    """Splits a node to the end: the same exact search on rows that are all here.

    Nodes of more than ``BULK`` rows are searched in two steps. Runs of values are summed first,
    which gives the gains between runs and bounds of those inside; the rows of the runs
    that may hold the best split are then searched value by value.
    """

    def __init__(self, f: Frontier, a: int, top: np.ndarray, total: float | None = None):
        self.a, self.top, self.levels = a, top, f.levels[a]
        self.code, self.penalty, self.min_leaf = int(f.code[a]), float(f.penalty[a]), f.min_leaf[a]
        self.min_drop, self.total = f.min_drop[a], f.total[a] if total is None else total
        self.count, self.splits, self.stats = 1, [], [self.top[None, :]]

    def grow(self, codes: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, signed: np.ndarray) -> pa.Table:
        """The nodes of the subtree; rows come as ranks and ``values`` as of :func:`ranks`."""
        self.values = [np.append(v, np.nan) for v in values]
        self.gaps = [bool((c == len(v)).any()) for c, v in zip(codes, values)]
        bulk = [] if self.levels < 1 or self.top[0] + self.top[3] < 2 * self.min_leaf else [_Bulk(
            0, self.top, self.levels, codes, y, signed, [0] * len(codes), [len(v) for v in values], len(y))]
        del codes, y, signed
        small: dict[float, list[_Bulk]] = {}
        while bulk:
            node = bulk.pop()
            if node.rows > BULK:
                bulk += self._halves(node)
                continue
            alike = small.setdefault(node.levels, [])
            alike.append(node)
            if sum(len(b.y) for b in alike) >= PIECE:
                self._finish(small.pop(node.levels))
        for alike in small.values():
            self._finish(alike)
        stats = np.concatenate(self.stats)
        out = {c: np.zeros(self.count) for c in ("threshold", "credit")}
        out |= {c: np.full(self.count, -1, np.int32) for c in ("f", "left")}
        for ids, feature, threshold, credit, left in self.splits:
            out["f"][ids], out["threshold"][ids], out["credit"][ids], out["left"][ids] = feature, threshold, credit, left
        return pa.Table.from_pydict({
            "a": pa.array(np.full(self.count, self.a), pa.int32()), "node": pa.array(np.arange(self.count), pa.int32()),
            **{c: pa.array(out[c]) for c in ("f", "threshold", "credit", "left")},
            **{c: pa.array(stats[:, j]) for j, c in enumerate(STATS)}})

    def _finish(self, nodes: list[_Bulk]) -> None:
        """Split nodes of few rows to the end, side by side."""
        slot = np.repeat(np.arange(len(nodes), dtype=np.int16), [len(b.y) for b in nodes])
        y, signed = (np.concatenate([getattr(b, c) for b in nodes]) for c in ("y", "signed"))
        x, orders = np.empty((len(self.values), len(y))), []
        for j, v in enumerate(self.values):
            code = np.concatenate([b.codes[j] for b in nodes]).astype(np.int64)
            x[j] = v.take(code)
            order = np.argsort(slot * np.int64(len(v)) + code, kind="stable")
            orders.append(order[code.take(order) < len(v) - 1].astype(np.int32))
        stats = np.stack([b.stats for b in nodes], 1)
        todo = [_Part(np.array([b.id for b in nodes]), stats, nodes[0].levels, slot, x, _moments(y, signed), orders)]
        while todo:
            todo += self._level(todo.pop())

    def _runs(self, p: _Bulk) -> _Runs:
        """Runs of a node's ranks and their sums."""
        most = max(64, int(RUNS * p.rows ** 0.5))
        width = [max(1, high - low) for low, high in zip(p.low, p.high)]
        shift = [max(0, (w - 1).bit_length() - most.bit_length() + 1) for w in width]
        runs = _Runs(p.rows, p.low, shift, [((w - 1) >> s) + 2 for w, s in zip(width, shift)], [])
        runs.sums = self._sums(runs, p.codes, p.y, p.signed)
        return runs

    def _sums(self, r: _Runs, codes: list[np.ndarray], y: np.ndarray, signed: np.ndarray) -> list[np.ndarray]:
        """Copies, sums and squares of treated rows and controls by run, for each feature."""
        sums = [np.zeros((3, 2 * n)) for n in r.size]
        for first in range(0, len(y), CHUNK):
            some = slice(first, first + CHUNK)
            w = np.abs(signed[some]).astype(np.float64)
            wy = w * y[some]
            wyy = wy * y[some]
            control = (signed[some] < 0).astype(np.int64)
            for j, code in enumerate(codes):
                at = self._run(r, j, code[some])
                at += at
                at += control
                for k, each in enumerate((w, wy, wyy)):
                    sums[j][k] += np.bincount(at, each, 2 * r.size[j])
        return [np.concatenate((t[:, ::2], t[:, 1::2])) for t in sums]

    def _run(self, r: _Runs, j: int, code: np.ndarray) -> np.ndarray:
        """The run of each rank of a feature."""
        at = code.astype(np.int64)
        if r.base[j]:
            at -= r.base[j]
        if r.shift[j]:
            at >>= r.shift[j]
        if self.gaps[j]:
            at[code == len(self.values[j]) - 1] = r.size[j] - 1
        return at

    def _halves(self, p: _Bulk) -> list[_Bulk]:
        """Split one node of many rows; returns the children to go on with."""
        if p.runs is None:
            p.runs = self._runs(p)
        best = self._search(p)
        if best is None:
            return []
        feature, code, after, credit, side = best
        threshold = _between(self.values[feature][code:code + 1], self.values[feature][after:after + 1])
        left = self.count
        self.count += 2
        self.splits.append((np.array([p.id]), feature, threshold, credit, left))
        pair = np.stack((side, p.stats - side))
        self.stats.append(pair)
        n = pair[:, 0] + pair[:, 3]
        if p.levels <= 1 or n.max() < 2 * self.min_leaf:
            return []
        bounds = []
        for k in range(2):
            low, high = list(p.low), list(p.high)
            (high if k == 0 else low)[feature] = code + 1 if k == 0 else after
            bounds.append((low, high))
        # The rows of the smaller child are taken out, the others stay where they are as long as few are gone.
        few = int(n[1] < n[0])
        goes = p.codes[feature] > code if few else p.codes[feature] <= code
        if p.rows < len(p.y):
            goes &= p.signed != 0
        use = np.flatnonzero(goes).astype(np.int32)
        codes, y, signed = [c.take(use) for c in p.codes], p.y.take(use), p.signed.take(use)
        out, rest = [], p.rows - len(use)
        if n[few] >= 2 * self.min_leaf:
            out.append(_Bulk(left + few, pair[few], p.levels - 1, codes, y, signed, *bounds[few], len(y)))
        if n[1 - few] >= 2 * self.min_leaf:
            runs = None
            if rest > BULK and 2 * rest > p.runs.rows:
                runs = replace(p.runs, sums=[a - b for a, b in zip(p.runs.sums, self._sums(p.runs, codes, y, signed))])
            p.signed[use] = 0
            codes, y, signed = p.codes, p.y, p.signed
            if runs is None or 4 * rest < 3 * len(y):
                use = np.flatnonzero(signed).astype(np.int32)
                codes, y, signed = [c.take(use) for c in codes], y.take(use), signed.take(use)
            out.append(_Bulk(left + 1 - few, pair[1 - few], p.levels - 1, codes, y, signed, *bounds[1 - few], rest, runs))
        return out

    def _search(self, p: _Bulk) -> tuple | None:
        """(feature, ranks before and behind, credit, left side) of the best split of a node of many rows."""
        whole = p.stats[:, None]
        n = p.stats[0] + p.stats[3]
        with np.errstate(all="ignore"):
            own = _impurity(self.code, whole, self.penalty)
        r, found = p.runs, []
        for sums in r.sums:
            used = np.flatnonzero(sums[0, :-1] + sums[3, :-1])
            inner = sums[:, used]
            found.append((used, inner, np.cumsum(inner, axis=1)))
        ends = np.cumsum([len(used) for used, _, _ in found])
        inner, upto = (np.concatenate([x[i] for x in found], axis=1) for i in (1, 2))
        before = upto - inner
        # Splits after a run, but for the last of a feature.
        edge = self._allowed(whole, own, upto)
        edge[ends[ends > 0] - 1] = np.nan
        top = np.max(edge, initial=0.0, where=~np.isnan(edge))
        # Bounds and gains are rounded differently.
        close = top - 1e-9 * (top + (p.stats[2] + p.stats[5]) / n) - 1e-11
        wide = np.flatnonzero(
            np.repeat([shift > 0 for shift in r.shift], np.diff(ends, prepend=0))
            & (upto[0] + upto[3] >= self.min_leaf) & (n - before[0] - before[3] >= self.min_leaf))
        hit = edge >= close
        open_ = hit.copy()
        open_[1:] |= hit[:-1]
        open_[wide[~(gain_bounds(self.code, self.penalty, whole, own, before[:, wide], inner[:, wide]) < close)]] = True
        splits = []
        for j, ((used, _, _), last) in enumerate(zip(found, ends)):
            here = slice(last - len(used), last)
            if r.shift[j] == 0:
                at = np.flatnonzero(hit[here])
                splits.append((used[at] + r.base[j], used[at + 1] + r.base[j], upto[:, here][:, at]))
            elif open_[here].any():
                splits.append(self._inside(p, j, used, before[:, here], open_[here]))
            else:
                splits.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((6, 0))))
        code, after, left = (np.concatenate([s[i] for s in splits], axis=-1) for i in range(3))
        gain = self._allowed(whole, own, left)
        worth, rank = n / self.total * gain, -np.round(gain, 12)
        good = np.flatnonzero((rank < 0) & (worth >= self.min_drop))
        if not len(good):
            return None
        i = good[np.argmin(rank[good])]
        feature = int(np.searchsorted(np.cumsum([len(s[0]) for s in splits]), i, side="right"))
        return feature, int(code[i]), int(after[i]), worth[i], left[:, i]

    def _allowed(self, whole, own, left: np.ndarray) -> np.ndarray:
        """Gains of splits of one node by their left sides, nan where not allowed."""
        out = np.full(left.shape[1], np.nan)
        right = whole - left
        fits = np.flatnonzero(
            (np.minimum(left[0] + left[3], right[0] + right[3]) >= self.min_leaf)
            & (np.minimum(np.minimum(left[0], left[3]), np.minimum(right[0], right[3])) >= 1))
        for low in range(0, len(fits), PIECE):
            at = fits[low:low + PIECE]
            out[at] = _gain(self.code, self.penalty, whole, own, left[:, at])
        return out

    def _inside(self, p: _Bulk, j, used, before, open_) -> tuple[np.ndarray, ...]:
        """(ranks before and behind, left sides) of all splits in and between neighbouring open runs."""
        take = np.zeros(p.runs.size[j], bool)
        take[used[open_]] = True
        rows = np.concatenate([
            first + np.flatnonzero(take.take(self._run(p.runs, j, p.codes[j][first:first + CHUNK])))
            for first in range(0, len(p.y), CHUNK)])
        if p.rows < len(p.y):
            rows = rows[p.signed.take(rows) != 0]
        code = p.codes[j].take(rows)
        order = np.argsort(code, kind="stable")
        code, rows = code.take(order).astype(np.int64), rows.take(order)
        s = _moments(p.y.take(rows), p.signed.take(rows))
        run = (code - p.runs.base[j]) >> p.runs.shift[j]
        place = np.searchsorted(used, run)
        upto = np.cumsum(s, axis=1)
        first = np.searchsorted(run, run)
        inner = upto - np.where(first > 0, upto[:, first - 1], 0.0)
        cut = np.flatnonzero((code[1:] > code[:-1]) & (place[1:] - place[:-1] <= 1))
        inner, at = inner[:, cut], place[cut]
        return code[cut], code[cut + 1], before[:, at] + np.concatenate((inner.real, inner.imag))

    def _best(self, p: _Part) -> tuple[np.ndarray, ...]:
        """(loss, feature, threshold, credit, left side) of each node's best split; loss inf if none."""
        k = len(p.ids)
        n = p.stats[0] + p.stats[3]
        loss, threshold, credit = np.full(k, np.inf), np.zeros(k), np.zeros(k)
        feature, side = np.zeros(k, np.int64), np.zeros((6, k))
        with np.errstate(all="ignore"):
            own = _impurity(self.code, p.stats, self.penalty)
        for j, order in enumerate(p.orders):
            v = p.x[j].take(order)
            rises = v[1:] > v[:-1]
            if k > 1:
                a = p.slot.take(order)
                rises &= a[1:] == a[:-1]
            cut = np.flatnonzero(rises)
            if not len(cut):
                continue
            if k > 1:
                first = np.searchsorted(a, np.arange(k, dtype=a.dtype))
                node = a.take(cut).astype(np.int64)
            else:
                first, node = np.zeros(1, np.int64), np.zeros(len(cut), np.int64)
            upto = []
            for c in p.s:
                sums = np.zeros(len(order) + 1, np.complex128)
                np.cumsum(c.take(order), out=sums[1:])
                upto.append(sums)
            counts = upto[0].take(cut + 1) - upto[0].take(first).take(node)
            n_l = counts.real + counts.imag
            least = np.minimum(
                np.minimum(counts.real, counts.imag),
                np.minimum(p.stats[0].take(node) - counts.real, p.stats[3].take(node) - counts.imag))
            fits = np.flatnonzero((np.minimum(n_l, n.take(node) - n_l) >= self.min_leaf) & (least >= 1))
            for low in range(0, len(fits), PIECE):
                at = fits[low:low + PIECE]
                here, end = node[at], cut[at]
                both = [u.take(end + 1) - u.take(first).take(here) for u in upto]
                left = np.stack([b.real for b in both] + [b.imag for b in both])
                gain = _gain(self.code, self.penalty, p.stats[:, here], None if own is None else own[here], left)
                worth = n[here] / self.total * gain
                rank = -np.round(gain, 12)
                good = np.flatnonzero((rank < 0) & (worth >= self.min_drop))
                if not len(good):
                    continue
                rank, here = rank[good], here[good]
                starts = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
                lowest = np.minimum.reduceat(rank, starts)
                hit = np.flatnonzero(rank == np.repeat(lowest, np.diff(np.append(starts, len(rank)))))
                hit = hit[np.concatenate(([True], here[hit][1:] != here[hit][:-1]))]
                hit = hit[rank[hit] < loss[here[hit]]]
                to, end, good = here[hit], end[good[hit]], good[hit]
                loss[to], feature[to], credit[to], side[:, to] = rank[hit], j, worth[good], left[:, good]
                threshold[to] = _between(v[end], v[end + 1])
        return loss, feature, threshold, credit, side

    def _level(self, p: _Part) -> list[_Part]:
        loss, feature, threshold, credit, side = self._best(p)
        split = np.flatnonzero(np.isfinite(loss))
        if not len(split):
            return []
        left = self.count + 2 * np.arange(len(split))
        self.count += 2 * len(split)
        self.splits.append((p.ids[split], feature[split], threshold[split], credit[split], left))
        # Children in node order, the left one first.
        stats = np.stack((side[:, split], p.stats[:, split] - side[:, split]), 2).reshape(6, -1)
        self.stats.append(stats.T)
        open_ = np.flatnonzero(stats[0] + stats[3] >= 2 * self.min_leaf) if p.levels > 1 else []
        if not len(open_):
            return []
        child = np.full((len(p.ids), 2), -1, np.int64)
        place = np.full(2 * len(split), -1, np.int64)
        place[open_] = np.arange(len(open_))
        child[split] = place.reshape(-1, 2)
        kind = np.int16 if len(open_) < 1 << 15 else np.int32
        rows = p.x.shape[1]
        if len(p.ids) == 1:
            to = np.where(p.x[feature[0]] <= threshold[0], kind(child[0, 0]), kind(child[0, 1]))
        else:
            goes = p.x.ravel().take((feature * rows).take(p.slot) + np.arange(rows)) <= threshold.take(p.slot)
            to = child.astype(kind).ravel().take(2 * p.slot.astype(np.int64) + ~goes)
        kept = np.flatnonzero(to >= 0)
        kept = kept[np.argsort(to[kept], kind="stable")]
        moved = np.empty(len(to), np.int32)
        moved[kept] = np.arange(len(kept), dtype=np.int32)
        slot, orders, places = to[kept], [], []
        for order in p.orders:
            key = to.take(order)
            stay = np.flatnonzero(key >= 0)
            key = key.take(stay)
            by = np.argsort(key, kind="stable")
            orders.append(moved.take(order.take(stay.take(by))))
            places.append(np.searchsorted(key.take(by), np.arange(len(open_) + 1)))
        edges = np.searchsorted(slot, np.arange(len(open_) + 1))
        ids, parts, first = left[0] + open_, [], 0
        while first < len(open_):
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + PIECE, side="right")) - 1)
            low, high = edges[first], edges[last]
            use = kept[low:high]
            parts.append(_Part(
                ids[first:last], stats[:, open_[first:last]], p.levels - 1, slot[low:high] - kind(first),
                np.take(p.x, use, axis=1), np.take(p.s, use, axis=1), [o[at[first]:at[last]] - np.int32(low) for o, at in zip(orders, places)]))
            first = last
        return parts


def row_source(df: DataFrame, id_col: str, treatment: str, y: Column, features) -> DataFrame:
    """(h, t, y, x0, x1, ...) of rows with an arm and an outcome."""
    x = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    return df.select(
        F.xxhash64(id_col).alias("h"), F.col(treatment).cast("int").alias("t"), y.alias("y"), *x
    ).where("t IN (0, 1) AND y IS NOT NULL")
