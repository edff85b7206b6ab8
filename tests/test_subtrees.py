"""Subtrees finished in one task, scans of large nodes and trees that configurations share."""

from dataclasses import replace

import pytest

from tauframe.operators import causal_forest as cf
from tauframe.operators import presorted


def units(spark, n=1500):
    rows = [
        (i, i * 7919 % 13 % 2, float(i * 31 % 17) + 3.0 * (i % 3 == 0) * (i * 7919 % 13 % 2),
         None if i % 11 == 0 else float(i * 37 % 601), float("nan") if i % 13 == 0 else float(i % 5), i % 3)
        for i in range(n)]
    return spark.createDataFrame(rows, "id long, t int, y double, a double, b double, c int").repartition(5)


def trees(df, grid):
    fitted = cf.fit_grid(df, "id", "t", "y", ["a", "b", "c"], grid)
    return {
        k: [[(n.id, n.parent, n.left, n.right, n.depth, n.feature, n.threshold, pytest.approx(n.value, rel=1e-9),
              n.n, pytest.approx(n.credit, abs=1e-9)) for n in t.nodes] for t in m.trees]
        for k, m in fitted.items()}


GRID = {
    "mse": cf.CausalTreeParams(criterion="standard_mse", min_samples_leaf=30),
    "cmse": cf.CausalTreeParams(min_samples_leaf=40, groups_penalty=0.25, max_depth=4),
    "forest": cf.CausalTreeParams(criterion="t_test", min_samples_leaf=40, trees=3, bootstrap=True),
    "forest_md2": cf.CausalTreeParams(criterion="t_test", min_samples_leaf=40, trees=3, bootstrap=True, max_depth=2),
}


@pytest.mark.parametrize("local", [0, 300])
@pytest.mark.parametrize("few", [0, 64])
def test_subtrees_equal_scans(spark, monkeypatch, local, few):
    df = units(spark)
    whole = trees(df, GRID)
    monkeypatch.setattr(presorted, "LOCAL_ROWS", local)
    monkeypatch.setattr(presorted, "FEW", few)
    monkeypatch.setattr(presorted, "PIECE", 200)
    assert trees(df, GRID) == whole
    assert len(whole["mse"][0]) > 20


def test_small_pieces_give_the_same_subtrees(spark, monkeypatch):
    df = units(spark)
    whole = trees(df, GRID)
    monkeypatch.setattr(presorted, "PIECE", 64)
    assert trees(df, GRID) == whole


def test_small_nodes_are_not_scanned_level_by_level(spark, monkeypatch):
    def never(*args):
        raise AssertionError("a scan for nodes that fit a task")

    monkeypatch.setattr(presorted, "best_splits", never)
    monkeypatch.setattr(presorted, "feature_lists", never)
    assert len(trees(units(spark, 600), GRID)["mse"][0]) > 5


def test_a_depth_limit_alone_grows_no_trees_of_its_own(spark, monkeypatch):
    grown = []
    original = cf._Grower.grow
    monkeypatch.setattr(cf._Grower, "grow", lambda self: (grown.extend(self.slots), original(self)))
    df = units(spark, 600)
    both = trees(df, {k: GRID[k] for k in ("forest", "forest_md2")})
    assert len(grown) == 3
    assert both["forest_md2"] == trees(df, {"forest_md2": GRID["forest_md2"]})["forest_md2"]
    assert replace(GRID["forest"], max_depth=2) == GRID["forest_md2"]
