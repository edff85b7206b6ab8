"""Trees grown whole by a task, and the search of nodes of many rows by runs of values."""

import numpy as np
import pytest

from tauframe.operators import causal_forest as cf
from tauframe.operators import presorted
from test_subtrees import GRID, trees, units


def test_trees_that_fit_a_task_need_no_scan(spark, monkeypatch):
    df = units(spark)
    whole = trees(df, GRID)

    def never(*args):
        raise AssertionError("a scan or a shuffle for a tree that fits a task")

    monkeypatch.setattr(presorted, "LOCAL_ROWS", 600)
    for name in ("best_splits", "feature_lists", "subtrees", "node_totals"):
        monkeypatch.setattr(presorted, name, never)
    assert trees(df, GRID) == whole


def test_whole_trees_equal_scans_and_dealt_subtrees(spark, monkeypatch):
    df = units(spark)
    whole = trees(df, GRID)
    monkeypatch.setattr(presorted, "WHOLE", 0)
    assert trees(df, GRID) == whole
    monkeypatch.setattr(presorted, "LOCAL_ROWS", 300)
    assert trees(df, GRID) == whole


def test_trees_come_in_lots_that_the_driver_holds(spark, monkeypatch):
    df = units(spark, 600)
    whole = trees(df, GRID)
    monkeypatch.setattr(presorted, "NODES", 1)
    assert trees(df, GRID) == whole


def test_empty_and_missing_features(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 5), None) for i in range(50)], "id long, t int, y double, a double")
    grid = {"one": cf.CausalTreeParams(min_samples_leaf=5)}
    assert len(cf.fit_grid(df, "id", "t", "y", ["a"], grid)["one"].trees[0].nodes) == 1
    assert len(cf.fit_grid(df.where("id < 0"), "id", "t", "y", ["a"], grid)["one"].trees[0].nodes) == 1


def test_rows_are_sent_through_many_trees_by_all_cores(spark):
    grid = {"one": cf.CausalTreeParams(min_samples_leaf=40, trees=cf.MANY_TREES, bootstrap=True)}
    df = units(spark, 600).coalesce(1)
    model = cf.fit_grid(df, "id", "t", "y", ["a", "b", "c"], grid)["one"]
    assert model.predict(df, "effect").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    counted = cf.leaf_prediction_values(model, df).groupBy("tree").sum("n").collect()
    assert [r[1] for r in counted] == [600] * cf.MANY_TREES


def rows(n=3000, seed=1):
    """(features, outcomes, signed copies) with ties, missing values and heavy ends."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=n), rng.integers(0, 700, n).astype(float), np.round(rng.normal(size=n) ** 3, 1), rng.integers(0, 3, n) * 1.0]
    x[0][rng.random(n) < 0.1] = np.nan
    x[2][rng.random(n) < 0.02] = np.inf
    signed = np.where(rng.random(n) < 0.4, 1, -1) * np.maximum(rng.poisson(1, n), 1)
    y = rng.normal(size=n) + (signed > 0) * (x[1] > 300) + 0.5 * (x[3] == 1)
    return x, y, signed.astype(np.int8)


def subtree(x, y, signed, criterion, penalty, levels=np.inf):
    s = presorted._moments(y, signed).sum(axis=1)
    top = np.concatenate((s.real, s.imag))
    f = presorted.Frontier(
        *[None] * 7, depth=0, seeds=None, bootstrap=None, stats=top[None, :], code=np.array([presorted.CRITERIA.index(criterion)]),
        penalty=np.array([penalty]), min_leaf=np.array([20.0]), min_drop=np.array([0.0]), total=np.array([top[0] + top[3]]),
        levels=np.array([levels]))
    codes, values = zip(*[presorted.ranks(v) for v in x])
    out = presorted._Subtree(f, 0, top).grow([*codes], [*values], y, signed.copy()).to_pydict()

    def path(i):
        if out["left"][i] < 0:
            return ()
        side = out["left"][i]
        left = tuple(pytest.approx(out[c][side], rel=1e-9, abs=1e-9) for c in presorted.STATS)
        return out["f"][i], out["threshold"][i], pytest.approx(out["credit"][i], rel=1e-9), left, path(side), path(side + 1)

    return path(0), len(out["node"])


@pytest.mark.parametrize("criterion", presorted.CRITERIA)
@pytest.mark.parametrize("penalty", [0.0, 0.25])
def test_runs_of_values_find_the_same_splits(monkeypatch, criterion, penalty):
    for seed in range(3):
        for levels in (np.inf, 4):
            data = rows(seed=seed)
            monkeypatch.setattr(presorted, "BULK", 1 << 30)
            single, count = subtree(*data, criterion, penalty, levels)
            monkeypatch.setattr(presorted, "BULK", 30)
            monkeypatch.setattr(presorted, "CHUNK", 500)
            assert subtree(*data, criterion, penalty, levels) == (single, count)
            assert count > (20 if levels > 4 else 8)


@pytest.mark.parametrize("code", [0, 1, 2])
def test_no_split_gains_more_than_its_bound(code):
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, first, size = 400, int(rng.integers(5, 200)), int(rng.integers(2, 150))
        signed = (np.where(rng.random(n) < rng.random(), 1, -1) * rng.integers(1, 4, n)).astype(np.int8)
        y = rng.normal(size=n) * rng.choice([0.1, 1, 10]) + rng.choice([0, 5]) + rng.choice([0, 3]) * (signed > 0)
        s = presorted._moments(y, signed)
        upto = np.cumsum(np.concatenate((s.real, s.imag)), axis=1)
        whole, last = upto[:, -1:], min(n - 5, first + size)
        penalty = float(rng.choice([0.0, 0.3]))
        with np.errstate(all="ignore"):
            own = presorted._impurity(code, whole, penalty)
            gain = presorted._gain(code, penalty, whole, own, upto[:, first:last])
        bound = presorted.gain_bounds(
            code, penalty, whole, own, upto[:, first - 1:first], upto[:, last:last + 1] - upto[:, first - 1:first])
        gain = gain[np.isfinite(gain)]
        if len(gain) and not np.isnan(bound[0]):
            assert gain.max() <= bound[0] * (1 + 1e-9) + 1e-9
