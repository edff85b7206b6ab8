"""Causal trees, forests, learners and the daily jobs on data with known effects."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tauframe.operators import causal_forest as cf
from tauframe.operators import learners as le
from tauframe.operators import presorted, propensity, ranking
from tauframe.plans import daily_matching, daily_targeting
from tauframe.sources import tables
from tauframe.spec import CausalSpec

SPEC = CausalSpec("id", "t", "y", ("a", "b"))


def known(spark, n=2500, seed=1, confounded=False):
    """Effect 2 where a > 0.5, else 0."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = round(rng.random(), 2), rng.randrange(5)
        t = int(rng.random() < (0.2 + 0.6 * a if confounded else 0.5))
        y = b * 0.3 + 2.0 * (a > 0.5) * t + rng.gauss(0, 0.5)
        rows.append((i, t, y, a, b))
    return spark.createDataFrame(rows, "id long, t int, y double, a double, b int")


def impurity(rows, crit, penalty):
    t, c = ([r["y"] for r in rows if r["t"] == k] for k in (1, 0))
    mean = lambda v: sum(v) / len(v)
    var = lambda v: sum(x * x for x in v) / len(v) - mean(v) ** 2
    pen = penalty * abs(len(t) - len(c)) / len(rows)
    if crit == "standard_mse":
        return var(t + c) + pen
    return var(t) / len(t) + var(c) / len(c) - (mean(t) - mean(c)) ** 2 + pen


def grow(rows, crit, min_leaf, depth, penalty, path=""):
    best = (1e-9, None)
    if depth > 0:
        for f in ("a", "b"):
            values = sorted({r[f] for r in rows})
            for lo, hi in zip(values, values[1:]):
                v = lo + (hi - lo) / 2
                left, right = [r for r in rows if r[f] <= v], [r for r in rows if r[f] > v]
                if min(len(left), len(right)) < min_leaf:
                    continue
                if any(len({r["t"] for r in s}) < 2 for s in (left, right)):
                    continue
                n = len(rows)
                gain = impurity(rows, crit, penalty) - sum(
                    len(s) / n * impurity(s, crit, penalty) for s in (left, right))
                if round(gain, 10) > round(best[0], 10):
                    best = (gain, (f, v, left, right))
    if best[1] is None:
        t, c = ([r["y"] for r in rows if r["t"] == k] for k in (1, 0))
        return {path: sum(t) / len(t) - sum(c) / len(c)}
    f, v, left, right = best[1]
    out = {}
    for sign, part in (("<=", left), (">", right)):
        step = f"{f} {sign} {v:.4f}"
        out.update(grow(part, crit, min_leaf, depth - 1, penalty, f"{path} and {step}" if path else step))
    return out


@pytest.mark.parametrize("crit,penalty", [("causal_mse", 0.0), ("causal_mse", 0.25), ("standard_mse", 0.0)])
def test_tree_equals_exhaustive_search(spark, crit, penalty):
    df = known(spark, 600)
    params = cf.CausalTreeParams(criterion=crit, max_depth=3, min_samples_leaf=60, groups_penalty=penalty)
    tree = cf.fit_causal_tree(df, "id", "t", "y", ["a", "b"], params).trees[0]
    got = {tree.path(n): n.value for n in tree.leaves()}
    want = grow([r.asDict() for r in df.collect()], crit, 60, 3, penalty)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_trees_grown_together_equal_trees_grown_alone(spark):
    df = known(spark, 800)
    grid = {k: replace(p, min_samples_leaf=80, max_depth=3) for k, p in cf.default_tree_grid().items()}
    together = cf.fit_grid(df, "id", "t", "y", ["a", "b"], grid)
    for name in ("ctree_mse", "ctree_cmse_p050", "ctree_ttest"):
        alone = cf.fit_causal_tree(df.repartition(3), "id", "t", "y", ["a", "b"], grid[name])
        paths = [sorted(m.trees[0].path(n) for n in m.trees[0].leaves()) for m in (alone, together[name])]
        assert paths[0] == paths[1]


def test_forest_finds_the_effect_and_its_feature(spark):
    df = known(spark)
    params = cf.CausalTreeParams(min_samples_leaf=150, max_depth=2, trees=5, bootstrap=True)
    model = cf.fit_grid(df, "id", "t", "y", ["a", "b"], {"f": params}, trees_per_pass=2)["f"]
    assert len(model.trees) == 5
    assert len({tuple(t.path(n) for n in t.leaves()) + tuple(n.value for n in t.leaves()) for t in model.trees}) > 1
    importance = {r["feature"]: r["importance"] for r in model.importance_frame(spark).collect()}
    assert importance["a"] > 0.8 and sum(importance.values()) == pytest.approx(1.0)
    tau = model.predict(df, "tau").groupBy((F.col("a") > 0.5).alias("high")).agg(F.avg("tau").alias("m"))
    means = {r["high"]: r["m"] for r in tau.collect()}
    assert means[True] == pytest.approx(2.0, abs=0.25) and means[False] == pytest.approx(0.0, abs=0.25)


def test_thresholds_are_exact_for_continuous_features(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        a, b = rng.random() * 1000, None if i % 17 == 0 else rng.choice([0.0, 1.0, 2.5, float("nan")])
        rows.append((i, i % 2, 3.0 * (a > 777) * (i % 2) + rng.gauss(0, 0.3), a, b))
    df = spark.createDataFrame(rows, "id long, t int, y double, a double, b double")
    params = cf.CausalTreeParams(max_depth=2, min_samples_leaf=30)
    got = {(r["feature"], round(r["threshold"], 9)): (r["gain"], r["n_left"], r["n_right"])
           for r in cf.causal_root_splits(df.repartition(5), "id", "t", "y", ["a", "b"], params).collect()}
    want = {}
    for f in ("a", "b"):
        value = lambda r: {"a": r[3], "b": r[4]}[f]  # noqa: B023, E731
        known = sorted({value(r) for r in rows if value(r) is not None and value(r) == value(r)})
        for low, high in zip(known, known[1:]):
            v = low + (high - low) / 2
            left = [r for r in rows if value(r) is not None and value(r) <= v]
            right = [r for r in rows if not (value(r) is not None and value(r) <= v)]
            if min(len(left), len(right)) < 30 or any(len({r[1] for r in s}) < 2 for s in (left, right)):
                continue
            as_dicts = lambda s: [{"t": r[1], "y": r[2]} for r in s]
            gain = impurity(as_dicts(rows), "causal_mse", 0) - sum(
                len(s) / len(rows) * impurity(as_dicts(s), "causal_mse", 0) for s in (left, right))
            want[f, round(v, 9)] = (gain, len(left), len(right))
    assert set(got) == set(want)
    for k, (gain, *sizes) in want.items():
        assert got[k][0] == pytest.approx(gain, abs=1e-9) and list(got[k][1:]) == sizes
    tree = cf.fit_causal_tree(df, "id", "t", "y", ["a", "b"], params).trees[0]
    best = max(want, key=lambda k: round(want[k][0], 12))
    assert (tree.features[tree.nodes[0].feature], round(tree.nodes[0].threshold, 9)) == best


def test_a_value_shared_by_most_rows_is_never_cut(spark):
    rows = [(i, i % 2, float(i % 7) + 2.0 * (i % 2) * (i % 5 == 0), 5.0 if i % 3 else float(i % 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t int, y double, a double").repartition(16)
    params = cf.CausalTreeParams(min_samples_leaf=20, max_depth=4)
    thresholds = {r["threshold"] for r in cf.causal_root_splits(df, "id", "t", "y", ["a"], params).collect()}
    assert thresholds <= {0.5, 1.5, 2.5, 4.0} and 4.0 in thresholds


def test_small_chunks_give_the_same_trees(spark, monkeypatch):
    df = known(spark, 900)
    grid = {"m": cf.CausalTreeParams(min_samples_leaf=40), "f": cf.CausalTreeParams(min_samples_leaf=60, trees=3, bootstrap=True)}
    paths = lambda fit: {k: [sorted((t.path(n), round(n.value, 9)) for n in t.leaves()) for t in m.trees] for k, m in fit.items()}
    whole = paths(cf.fit_grid(df, "id", "t", "y", ["a", "b"], grid))
    monkeypatch.setattr(presorted, "OFFSETS", 64)
    assert paths(cf.fit_grid(df.repartition(3), "id", "t", "y", ["a", "b"], grid)) == whole


def test_leaf_counts_cover_all_rows_of_every_tree(spark):
    df = known(spark, 600)
    params = cf.CausalTreeParams(min_samples_leaf=60, trees=4, bootstrap=True)
    model = cf.fit_grid(df, "id", "t", "y", ["a", "b"], {"f": params})["f"]
    got = cf.leaf_prediction_values(model, df).toPandas()
    assert (got.groupby("tree").n.sum() == 600).all() and got.tree.nunique() == 4
    mean = (got.value * got.n).sum() / 4 / 600
    assert model.predict(df, "tau").agg(F.avg("tau")).first()[0] == pytest.approx(mean)
    assert model.predict(df.where("id < 0"), "tau").collect() == []


def test_leaf_report_with_an_arm_missing_in_a_leaf(spark):
    from tauframe.plans.catalog.trees import fixed_causal_tree

    rows = [(i, i % 2, float(i), 100000.0 if i < 50 else 300000.0, 0.0, 3) for i in range(100)]
    df = spark.createDataFrame(rows, "uid long, treatment int, y double, price double, acctbal double, omonth int")
    test = df.where("not (price > 250000 and treatment = 0)")
    out = {r["path"]: r for r in cf.tree_leaf_report(
        fixed_causal_tree(), df, test, "treatment", "y", binary=False).collect()}
    dear = out["price > 250000.0000"]
    assert dear["num_c_test"] == 0 and dear["uplift_test"] is None and dear["num_t_test"] == 25
    assert len(out) == 3 and out["price <= 250000.0000 and omonth > 6.5000"]["num_t_test"] is None
    nodes = cf.tree_node_report(fixed_causal_tree(), df, test, "treatment", "y", binary=False)
    root = nodes.where("node_id = 0").first()
    assert (root["num_t_test"], root["share_train"]) == (50, 1.0)


@pytest.mark.parametrize("name", list(le.LEARNERS))
def test_learners_beat_a_random_order(spark, name):
    df = known(spark, confounded=True)
    model = le.LEARNERS[name](df, SPEC, le.boosted(max_iter=8))
    scored = model.predict(df, "tau").withColumn("noise", F.rand(3))
    assert scored.count() == df.count()
    q = {r["model"]: r["qini"] for r in ranking.qini_scores(scored, "t", "y", ["tau", "noise"]).collect()}
    assert q["tau"] > q["noise"] + 0.03
    means = {r["high"]: r["m"] for r in scored.groupBy((F.col("a") > 0.5).alias("high"))
             .agg(F.avg("tau").alias("m")).collect()}
    assert means[True] - means[False] > 0.8


def test_propensity_models_rank_the_treated(spark):
    df = known(spark, confounded=True)
    for model in (
        propensity.fit_logistic(df, SPEC), propensity.fit_boosted(df, SPEC, max_iter=5, max_depth=2),
        propensity.search_boosted(df, SPEC, 2, 2, space={"maxIter": [2], "maxDepth": [2], "stepSize": [0.1, 0.3],
                                                         "subsamplingRate": [1.0]}),
    ):
        means = {r["t"]: r["m"] for r in model.score(df).groupBy("t").agg(F.avg("ps").alias("m")).collect()}
        assert means[1] > means[0] + 0.05 and 0.5 < model.accuracy(df) < 1


def test_daily_matching_writes_pairs_and_improves_balance(spark, tmp_path):
    df = known(spark, confounded=True).withColumn("ds", F.lit("20240101")).withColumn(
        "c", F.when(F.col("id") % 50 != 0, F.concat(F.lit("k"), F.col("b"))))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    tables.write_partition(df, source)
    plan = daily_matching.MatchingPlan(
        spec=SPEC, numeric=("a",), categorical=("c",), model="logistic", casts={"b": "bigint"})
    out = daily_matching.run(spark, source, target, "p_20240101", plan)
    written = tables.read_partitions(spark, target, ["20240101"])
    assert written.count() == out["pairs"].count() > 0
    assert written.select("matched_uid").distinct().count() == written.count()
    smd = {r["matching"]: r["smd"] for r in out["balance"].collect()}
    assert smd["after"] < smd["before"]


def test_daily_targeting_flags_half_of_the_rows(spark, tmp_path):
    df = known(spark, 1500).withColumn("ds", F.lit("20240101")).withColumn("c", F.col("b").cast("string"))
    to_score = known(spark, 800, seed=2).withColumn("ds", F.lit("20240101")).withColumn(
        "c", F.col("b").cast("string")).withColumn("t", F.when(F.col("id") % 3 == 0, F.col("t")))
    tree = cf.CausalTreeParams(min_samples_leaf=100, max_depth=2)
    plan = daily_targeting.TargetingPlan(
        spec=SPEC, categorical=("c",), leakage=("b",),
        tree_grid={"tree": tree, "ttree": replace(tree, criterion="t_test")},
        forest_grid={"forest": replace(tree, trees=2, bootstrap=True)}, top_models=2, top_features=3)
    source, predict, target = (str(tmp_path / p) for p in ("train", "predict", "out"))
    tables.write_partition(df, source)
    tables.write_partition(to_score, predict)
    out = daily_targeting.run(spark, source, predict, target, "20240101", plan)
    assert out["ranking"].count() == 2 and out["deciles"].count() == 10
    flags = tables.read_partitions(spark, target, ["20240101"])
    share = flags.agg(F.avg("is_high_uplift")).first()[0]
    assert 0.35 < share < 0.65
    high = flags.join(to_score.select("id", "a"), "id").where("is_high_uplift = 1")
    assert high.agg(F.avg((F.col("a") > 0.5).cast("int"))).first()[0] > 0.9
