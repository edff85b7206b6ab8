"""Uplift trees against a recursive definition on a few hundred rows."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tauframe.operators import uplift_tree as ut

SHARES = [p / 100 for p in (3, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 97)]


def kl(p, q):
    q = min(max(q, 1e-6), 1 - 1e-6)
    if p == 0:
        return -math.log(1 - q)
    if p == 1:
        return -math.log(q)
    return p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q))


def ent(p):
    return -p * math.log(p) if p > 0 else 0.0


def summary(rows, arms, parent, min_t, reg):
    out = []
    for k in range(arms):
        ys = [r["y"] for r in rows if r["t"] == k]
        n, s = len(ys), sum(ys)
        if parent is None:
            p = s / n if n else 0.0
        else:
            p = (s + parent["p"][k] * reg) / (n + reg) if n > min_t else parent["p"][k]
        out.append((n, p))
    t = np.array([r["t"] for r in rows], float)
    y = np.array([r["y"] for r in rows], float)
    slope = np.cov(t, y)[0, 1] / np.var(t) if len(rows) > 1 and np.var(t) > 0 else None
    return {"n": [o[0] for o in out], "p": [o[1] for o in out], "slope": slope, "rows": len(rows)}


def score(crit, s):
    p, c = s["p"], s["p"][0]
    if crit == "ED":
        return sum(2 * (t - c) ** 2 for t in p[1:])
    if crit == "Chi":
        return sum((t - c) ** 2 / max(1e-6, c) + (t - c) ** 2 / max(1e-6, 1 - c) for t in p[1:])
    if crit == "DDP":
        return sum(t - c for t in p[1:])
    if crit == "CTS":
        return -max(p)
    if crit == "CAPE":
        return s["slope"]
    return sum(kl(t, c) for t in p[1:])


def normalizer(a, left):
    nc, nt = a["n"][0], sum(a["n"][1:])
    pt, pc = sum(left["n"][1:]) / (nt + 0.1), left["n"][0] / (nc + 0.1)
    out = 0.9 * (ent(nt / (nt + nc)) + ent(nc / (nt + nc))) * kl(pt, pc)
    for k in range(1, len(a["n"])):
        n, share = a["n"][k], left["n"][k] / (a["n"][k] + 0.1)
        out += 0.1 * (ent(n / (n + nc)) + ent(nc / (n + nc))) * kl(pc, share)
        out += n / (nt + nc) * ent(share)
    return out + nc / (nt + nc) * ent(pc) + 0.5


def gain_of(crit, a, left, right):
    sl, sr, sa = score(crit, left), score(crit, right), score(crit, a)
    w = left["rows"] / a["rows"]
    if crit == "CTS":
        return sa - w * sl - (1 - w) * sr
    if crit == "DDP":
        return abs(sl - sr)
    if crit == "CAPE":
        return w * (1 - w) * (sl - sr) ** 2
    return (w * sl + (1 - w) * sr - sa) / normalizer(a, left)


def grow(rows, arms, features, crit, min_leaf, max_depth, min_t=10, reg=100, depth=1, parent=None,
         path="", held=None, scale=1.0):
    here = summary(rows, arms, parent, min_t, reg)
    best = (0.0, None)
    for f in features:
        text = isinstance(rows[0][f], str)
        values = sorted({r[f] for r in rows})
        if not text and len(values) > 10:
            values = sorted(set(np.percentile([r[f] for r in rows], [s * 100 for s in SHARES])))
        for v in values:
            test = (lambda r: r[f] == v) if text else (lambda r: r[f] >= v)
            left, right = [r for r in rows if test(r)], [r for r in rows if not test(r)]
            if len(left) <= min_leaf or len(right) <= min_leaf:
                continue
            sl, sr = (summary(x, arms, here, min_t, reg) for x in (left, right))
            if min(sl["n"] + sr["n"]) < min_t:
                continue
            if held is not None:
                parts = [[r for r in held if test(r)], [r for r in held if not test(r)]]
                far = False
                for fit, part in ((sl, parts[0]), (sr, parts[1])):
                    other = summary(part, arms, here, 10, 100)
                    pairs = list(zip(fit["p"] + [fit["slope"]], other["p"] + [other["slope"]]))
                    far |= any(
                        None not in (a, b) and abs(b - a) > min(a, b) / scale for a, b in pairs)
                if far:
                    continue
            g = gain_of(crit, here, sl, sr)
            if g is not None and round(g, 12) > round(best[0], 12):
                best = (g, (f, v, text, test))
    if best[1] is None or depth >= max_depth:
        return {path: here}
    f, v, text, test = best[1]
    signs = ("==", "!=") if text else (">=", "<")
    out = {}
    for sign, keep in zip(signs, (True, False)):
        sub = [r for r in rows if test(r) == keep]
        sub_held = None if held is None else [r for r in held if test(r) == keep]
        step = f"{f} {sign} {v if text else float(v)}"
        out.update(grow(sub, arms, features, crit, min_leaf, max_depth, min_t, reg, depth + 1, here,
                        f"{path} and {step}" if path else step, sub_held, scale))
    return out


def sample(seed, n, arms):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = round(rng.random(), 3), rng.randrange(6), rng.choice(["red", "green", "blue"])
        t = rng.randrange(arms)
        lift = 0.35 * (a > 0.5) * (t > 0) + 0.1 * t * (c == "red")
        rows.append({"id": i, "t": t, "a": a, "b": float(b), "c": c,
                     "y": float(rng.random() < min(0.2 + lift, 0.95))})
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, t int, a double, b double, c string, y double")


def assert_same(model, want):
    got = {model.path(n): n for n in model.leaves()}
    assert set(got) == set(want)
    for path, node in got.items():
        assert list(node.n) == want[path]["n"]
        assert node.p == pytest.approx(want[path]["p"], abs=1e-9)


@pytest.mark.parametrize("crit", ["KL", "ED", "Chi", "DDP", "CTS", "CAPE"])
def test_tree_equals_recursive_definition(spark, crit):
    rows = sample(11, 700, 2)
    params = ut.UpliftTreeParams(criterion=crit, max_depth=4, min_samples_leaf=40)
    model = ut.fit_uplift_tree(frame(spark, rows), "t", "y", ["a", "b", "c"], params)
    assert_same(model, grow(rows, 2, ["a", "b", "c"], crit, 40, 4))


def test_several_arms(spark):
    rows = sample(12, 900, 4)
    want = grow(rows, 4, ["a", "b"], "KL", 60, 3)
    params = ut.UpliftTreeParams(max_depth=3, min_samples_leaf=60)
    assert_same(ut.fit_uplift_tree(frame(spark, rows), "t", "y", ["a", "b"], params), want)


def test_validation_rejects_unstable_splits(spark):
    rows, held = sample(13, 700, 2), sample(14, 500, 2)
    params = ut.UpliftTreeParams(criterion="ED", max_depth=3, min_samples_leaf=50)
    model = ut.fit_uplift_tree(
        frame(spark, rows), "t", "y", ["a", "b"], params, validation=frame(spark, held))
    assert_same(model, grow(rows, 2, ["a", "b"], "ED", 50, 3, held=held))


def test_leaf_report_covers_the_test_rows(spark):
    rows = sample(15, 1200, 2)
    df = frame(spark, rows)
    model, report = ut.uplift_tree(
        df, "id", "t", "y", ["a", "b", "c"], ut.UpliftTreeParams(max_depth=4), min_leaf_share=0.05)
    got = report.toPandas()
    from tauframe.operators.sampling import split

    _, test = split(df, "id", 0.8, 25)
    assert got["num_t_test"].sum() + got["num_c_test"].sum() == test.count()
    imp = {r["feature"]: r["importance"] for r in model.importance_frame(spark).collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and imp["a"] == max(imp.values())


def test_honest_refill_and_root_only_tree(spark):
    rows = sample(16, 300, 2)
    df = frame(spark, rows)
    params = ut.UpliftTreeParams(max_depth=3, min_samples_leaf=200)
    model = ut.fit_uplift_tree(df, "t", "y", ["a"], params)
    assert len(model.nodes) == 1 and model.path(model.nodes[0]) == ""
    assert model.leaf_report(df, "t", "y").count() == 1
    ut.refill(model, df.where("id < 100"), "t", "y")
    assert sum(model.nodes[0].n) == 100


def test_missing_values_fail_the_test(spark):
    model = ut.fixed_tree(["a"], {0: ("a", 0.5, 1, 2)})
    df = spark.createDataFrame([(1, 0.7), (2, 0.2), (3, None)], "id long, a double")
    assert {r["id"]: r["leaf_id"] for r in model.route(df).collect()} == {1: 1, 2: 2, 3: 2}


def test_decision_prefers_the_best_arm():
    from tauframe.operators.tree_tables import TreeNode

    node = TreeNode(0, n=[100, 100, 100], s=[30, 20, 50], q=[30, 20, 50], p=[0.3, 0.2, 0.5])
    d = ut.arm_decision(node, True)
    assert (d["best"], d["subopt"], d["widest"], d["widest_sign"]) == (2, 2, 2, 1)
    assert d["diff"] == [-0.1, 0.2]
    worse = ut.arm_decision(TreeNode(0, n=[10, 10], s=[5, 4], q=[5, 4], p=[0.5, 0.4]), True)
    assert (worse["best"], worse["subopt"]) == (0, 1)


def test_no_arm_is_left_out(spark):
    df = spark.range(3000).selectExpr("cast(id % 1500 as string) AS t")
    assert len(ut.learn_arms(df, "t", "0")) == 1500


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_variances_at_any_level(spark, shift):
    df = spark.createDataFrame(
        [(str(i % 2), float(i % 10), shift + (i * 7 % 11) / 10 + (i % 2) * (i % 10 > 4)) for i in range(600)],
        "t string, a double, y double")
    params = ut.UpliftTreeParams(criterion="ED", max_depth=2, min_samples_leaf=50, binary_outcome=False, n_reg=0)
    model = ut.fit_uplift_tree(df, "t", "y", ["a"], params)
    root = model.nodes[0]
    for k, r in enumerate(df.groupBy("t").agg(F.var_pop("y").alias("v")).orderBy("t").collect()):
        assert root.q[k] / root.n[k] == pytest.approx(r["v"], rel=1e-6)
    for n in model.nodes[1:]:
        assert all(0 <= q / c < 1 for q, c in zip(n.q, n.n))
    filled = model.fill(df.where("a < 3"), "t", "y").count()
    assert filled == len(model.nodes)
