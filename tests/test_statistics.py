"""Test statistics, ordering, quantiles, sampling, preparation and panels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauframe.functions import stats
from tauframe.operators import describe, did, ordered, prepare, quantiles, ranking, sampling
from tauframe.sources import tables


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    # Modified Lentz evaluation of the incomplete-beta continued fraction.
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t by the regularised incomplete beta."""
    if t is None or df is None or not math.isfinite(t) or not df > 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1.0 - front * _beta_continued_fraction(b, a, 1.0 - x) / b


def test_student_t_against_the_plain_fraction(spark):
    cases = [(t, v) for t in (0.0, 1e-9, 0.3, 1.7, 2.0, 4.5, -12.0, 60.0, 1e4) for v in (1, 2, 3, 7, 56, 500, 999, 1001, 20_000, 10**6)]
    cases += [(None, 3), (1.0, 0), (math.nan, 3), (math.inf, 3), (1.0, None)]
    df = spark.createDataFrame(cases, "t double, dof long").select("t", "dof", stats.t_p_value("t", "dof").alias("p"))
    for r in df.collect():
        want = student_t_two_sided(r["t"], r["dof"])
        if math.isnan(want):
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(want, rel=1e-9 if r["dof"] <= 1000 else 2e-7)
    # Fixed values from published tables of critical points.
    for t, dof, p in ((2.228, 10, 0.05), (2.756, 29, 0.01), (12.706, 1, 0.05)):
        assert student_t_two_sided(t, dof) == pytest.approx(p, abs=2e-4)


def test_normal_p_is_close_to_erfc(spark):
    zs = [0.0, 0.1, 0.7, 1.96, 3.3, -2.5, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(stats.two_sided_normal_p(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=2e-7)


def test_two_sample_t_on_two_short_series(spark):
    a, b = [1.0, 2.5, 3.1, 4.4, 5.0, 2.2, 3.3], [2.0, 3.5, 5.1, 4.9, 6.0, 3.2, 4.4]
    df = spark.createDataFrame([(0, v) for v in a] + [(1, v) for v in b], "t int, y double")
    r = describe.compare_arms(df, "t", "y").first()
    sp = math.sqrt((6 * np.var(a, ddof=1) + 6 * np.var(b, ddof=1)) / 12)
    t = (np.mean(a) - np.mean(b)) / (sp * math.sqrt(2 / 7))
    assert (r["t_stat"], r["dof"]) == (pytest.approx(t), 12)
    assert r["significant"] == (r["p_value"] <= 0.05)


def test_constant_feature_has_no_difference(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "t int, y double")
    r = describe.balance_table(df, "t", ["y"]).first()
    assert r["smd"] is None and r["p_value"] is None


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_running_totals_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([0.0, 0.0, 0.0, 1.0, 2.0]), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, s double, v long").repartition(partitions)
    got = ordered.running_totals(df, [F.desc("s"), F.col("id")], {"run": F.col("v")}, by=["g"])
    want, count, total = {}, {}, {}
    for i, g, s, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + v
        want[i] = (count[g], total[g])
    assert {r["id"]: (r["pos"], r["run"]) for r in got.collect()} == want


def test_running_totals_in_hash_cells(spark):
    df = spark.range(1000).withColumn("h", ordered.hash_order("id", 3))
    got = ordered.running_totals(df, [F.col("h"), F.col("id")], bucket=ordered.hash_cell("h"))
    rows = sorted((r["h"], r["id"], r["pos"]) for r in got.collect())
    assert [r[2] for r in rows] == list(range(1, 1001))


@pytest.mark.parametrize("n", [1, 2, 11, 400])
def test_percentiles_agree_with_numpy(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 50, 7.0, 8.0]) for _ in range(n)]
    df = spark.createDataFrame([("x", v) for v in values], "g string, v double")
    counts = quantiles.value_counts(df, ["g"], "v")
    shares = [0.03, 0.25, 0.5, 0.97]
    want = np.percentile(values, [3, 25, 50, 97])
    r = quantiles.percentiles(counts, ["g"], "v", shares, 3).first()
    assert r["percentiles"] == pytest.approx(list(want))
    assert r["distinct_values"] == len(set(values))
    assert r["lowest"] == sorted(set(values))[:3]
    whole = quantiles.percentiles(quantiles.value_counts(df, [], "v"), [], "v", shares).first()
    assert whole["percentiles"] == pytest.approx(list(want))


def test_samples_have_exact_sizes_and_repeat(spark):
    df = spark.range(5000).withColumn("t", (F.col("id") % 5 == 0).cast("int"))
    cut = sampling.downsample_control(df, "id", "t", 1)
    ids = {r["id"] for r in cut.collect()}
    assert len(ids) == 2000
    again = sampling.downsample_control(df.repartition(13), "id", "t", 1)
    assert ids == {r["id"] for r in again.collect()}
    flipped = df.withColumn("t", 1 - F.col("t"))
    even = sampling.downsample_larger_arm(flipped, "id", "t", 40, 42)
    assert even.groupBy("t").count().select("count").distinct().count() == 1
    assert sampling.take_by_hash(df, "id", 10**6, 1).count() == 5000
    assert sampling.take_by_hash(df, "id", 0, 1).count() == 0


def test_folds_are_balanced_per_label(spark):
    df = spark.range(1003).withColumn("t", (F.col("id") % 3 == 0).cast("int"))
    sizes = sampling.stratified_folds(df, "id", "t", 5, 9).groupBy("t", "fold").count().toPandas()
    for _, part in sizes.groupby("t"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1


def test_split_parts_are_disjoint_and_complete(spark):
    a, b = sampling.split(spark.range(3000), "id", 0.67, 5)
    assert a.count() + b.count() == 3000 and 0.6 < a.count() / 3000 < 0.74
    assert a.join(b, "id").count() == 0


def test_fill_mode_ties_and_typed_fill(spark):
    df = spark.createDataFrame(
        [("b", 1, 2.0), ("a", 3, None), (None, None, 4.0), ("a", 3, 4.0), ("b", 1, None)],
        "s string, i int, d double")
    filled = prepare.fill_mode(df).collect()
    assert filled[2]["s"] == "a" and filled[2]["i"] == 1 and filled[1]["d"] == 4.0
    typed = prepare.fill_typed(df).collect()
    assert typed[2]["i"] == pytest.approx(2.0) and typed[1]["d"] == pytest.approx(10 / 3)


def test_encoder_keeps_training_categories(spark):
    train = spark.createDataFrame([("x.1",), ("y",)], "c string")
    other = spark.createDataFrame([("y",), ("z",), (None,)], "c string")
    out = prepare.OneHot.fit(train, ["c"]).transform(other)
    assert out.columns == ["c_x_1", "c_y"]
    assert [tuple(r) for r in out.collect()] == [(0, 1), (0, 0), (0, 0)]


def test_deciles_when_rows_do_not_divide_and_all_scores_tie(spark):
    rows = [(i, i % 2, float(i % 3), 0.5) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, t int, y double, s double")
    got = ranking.uplift_deciles(df, "id", "t", "y", "s").orderBy("percentile").toPandas()
    sizes = (got["n_treatment"] + got["n_control"]).tolist()
    assert sizes == [len(p) for p in np.array_split(np.arange(23), 10)]
    order = list(range(22, -1, -1))
    first = [rows[i] for i in order[:3]]
    assert got["n_treatment"][0] == sum(r[1] for r in first)


def test_gain_ends_at_the_average_effect_and_qini_of_a_tie_is_flat(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(2), rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t int, y double, s double").withColumn("flat", F.lit(1.0))
    gains = ranking.cumulative_gain(df, "id", "t", "y", "s")
    last = gains.orderBy(F.desc("rank")).first()
    ate = describe.average_effect(df, "t", "y").first()["ate"]
    assert last["gain"] == pytest.approx(ate * 400)
    want = max(gains.collect(), key=lambda r: (r["gain"], -r["rank"]))
    best = ranking.best_cut(gains, "s").first()
    assert (best["rank"], best["threshold"]) == (want["rank"], want["s"])
    scores = {r["model"]: r["qini"] for r in ranking.qini_scores(df, "t", "y", ["s", "flat"]).collect()}
    assert scores["flat"] == pytest.approx(0.0, abs=1e-12)


def test_qini_is_null_without_controls(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0.3), (2, 1, 0.0, 0.2)], "id long, t int, y double, s double")
    assert ranking.qini_scores(df, "t", "y", ["s"]).first()["qini"] is None


def panel(spark, effect):
    rng = random.Random(8)
    rows = []
    for d in range(1, 29):
        for g in (0, 1):
            y = 2.0 + 0.5 * g + 0.1 * d + effect * g * (d >= 15) + rng.gauss(0, 0.02)
            rows.append((f"2023-11-{d:02d}", g, y))
    df = spark.createDataFrame(rows, "day string, g int, y double").withColumn("dt", F.to_date("day"))
    return did.add_period(df, "dt", "2023-11-15")


def test_panel_regressions_recover_the_effect(spark):
    df = panel(spark, 0.7)
    direct = describe.difference_in_differences(df, "g", "post", "y").first()["effect"]
    plain = {r["term"]: r for r in did.did_regression(df, "y", "post", "g").collect()}
    dated = {r["term"]: r for r in did.did_regression_by_date(df, "y", "dt", "post", "g").collect()}
    assert direct == pytest.approx(0.7, abs=0.03)
    for fit in (plain, dated):
        assert fit["post_x_g"]["estimate"] == pytest.approx(direct, abs=1e-6)
    assert dated["post_x_g"]["std_error"] < plain["post_x_g"]["std_error"]
    trend = did.parallel_trend_test_by_date(df, "y", "dt", "g", "2023-11-15", "2023-11-08")
    assert {r["term"]: r for r in trend.collect()}["placebo_x_g"]["p_value"] > 0.01


def test_aliased_regressors_are_left_out(spark):
    df = spark.createDataFrame([(float(i), float(i % 4)) for i in range(40)], "a double, b double")
    df = df.withColumn("twice", 2 * F.col("a") + F.col("b")).withColumn("one", F.lit(1.0))
    df = df.withColumn("y", 3 * F.col("a") - F.col("b") + 1 + F.col("a") % 3)
    rng = np.array([[r["a"], r["b"], r["twice"], r["one"]] for r in df.collect()])
    gram = (rng - rng.mean(0)).T @ (rng - rng.mean(0))
    assert did.independent_columns(gram) == [0, 1]
    some = {r["term"]: r for r in did.ols(df, "y", ["a", "b", "twice", "one"]).collect()}
    plain = {r["term"]: r for r in did.ols(df, "y", ["a", "b"]).collect()}
    assert set(some) == {"a", "b", "intercept"} and some == plain


def plain_ols(x, y):
    """Estimates, errors, t, R2 and degrees of freedom by a QR fit on all columns."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    left = y - x @ b
    dof = len(y) - x.shape[1]
    errors = np.sqrt(left @ left / dof * np.diag(np.linalg.inv(x.T @ x)))
    return b, errors, b / errors, 1 - left @ left / ((y - y.mean()) @ (y - y.mean())), dof


def test_fits_equal_dense_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 300
    x1, x2, day = rng.normal(50_000, 1, n), rng.normal(size=n), rng.integers(1, 8, n)
    y = 1e6 + 2 * x1 - x2 + 0.3 * day + rng.normal(size=n)
    rows = [(float(a), float(b), f"2023-11-{d:02d}", float(c)) for a, b, d, c in zip(x1, x2, day, y)]
    rows += [(None, 1.0, "2023-11-01", 5.0), (1.0, 1.0, None, 5.0), (1.0, 1.0, "2023-11-01", None)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, day string, y double")
    flags = np.stack([(day == d).astype(float) for d in range(2, 8)], 1)
    ones = np.ones((n, 1))
    plain = {r["term"]: r for r in did.ols(df.where("day is not null"), "y", ["x1", "x2"]).collect()}
    dated = {r["term"]: r for r in did.ols_with_effects(
        df, "y", ["x1", "x2"], F.date_format(F.to_date("day"), "MMdd")).collect()}
    for fit, extra, names in ((plain, [], []), (dated, [flags], [f"_11{d:02d}" for d in range(2, 8)])):
        x = np.hstack([np.stack([x1 - 50_000, x2], 1), *extra, ones])
        b, se, _, r2, dof = plain_ols(x, y)
        for i, term in enumerate(["x1", "x2", *names]):
            assert fit[term]["estimate"] == pytest.approx(b[i], rel=1e-7)
            assert fit[term]["std_error"] == pytest.approx(se[i], rel=1e-7)
            assert fit[term]["t_stat"] == pytest.approx(b[i] / se[i], rel=1e-7)
        assert fit["intercept"]["estimate"] == pytest.approx(b[-1] - 50_000 * b[0], rel=1e-7)
        assert fit["x1"]["r2"] == pytest.approx(r2, abs=1e-9) and fit["x1"]["dof"] == dof
        assert set(fit) == {"x1", "x2", "intercept", *names}
    assert did.ols(df.where("y < 0"), "y", ["x1"]).collect() == []


def test_month_day_numbers_with_three_digits(spark):
    df = did.day_from_month_day(spark.createDataFrame([(704,), (1204,)], "md int"), "md")
    assert [str(r["dt"]) for r in df.collect()] == ["2023-07-04", "2023-12-04"]


def test_partition_overwrite_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "20240101"), (2, "20240102")], "id long, ds string")
    tables.write_partition(df, path)
    tables.write_partition(spark.createDataFrame([(9,)], "id long"), path, "p_20240102")
    out = tables.read_partitions(spark, path, ["p_20240102"])
    assert [r["id"] for r in out.collect()] == [9]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "20240102" in plan
    assert tables.read_partitions(spark, path).count() == 2


def test_score_scan_reads_only_the_needed_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = describe.counts_by(df.where("o_totalprice > 5"), "o_orderstatus", ["o_orderkey"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,5.0)]" in text
    assert "o_orderdate" not in text


def test_partitions_keep_their_zeros_and_can_be_emptied(spark, tmp_path):
    from tauframe.sources import tables

    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "0001"), (2, "0002"), (3, "0010")], "id long, ds string")
    tables.write_partition(df, path)
    got = tables.read_partitions(spark, path, ["0001", "p_0002"])
    assert sorted(map(tuple, got.select("id", "ds").collect())) == [(1, "0001"), (2, "0002")]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString() or "ds#" in got._jdf.queryExecution().toString()
    assert tables.read_partitions(spark, path).count() == 3
    tables.write_partition(df.where("id < 0"), path, "0002")
    assert tables.read_partitions(spark, path, ["0002"]).count() == 0
    tables.write_partition(df.where("id = 1"), path, "p_0010")
    assert sorted(map(tuple, tables.read_partitions(spark, path).select("id", "ds").collect())) == [(1, "0001"), (1, "0010")]


def test_one_hot_names_and_many_categories(spark):
    from tauframe.operators import prepare

    df = spark.createDataFrame([(1, "a.b"), (2, "a_b"), (3, "A_B"), (4, None)], "id long, c string")
    encoder = prepare.OneHot.fit(df, ["c"])
    out = encoder.transform(df)
    assert len({n.lower() for n in encoder.output_columns}) == 3
    rows = {r["id"]: [r[n] for n in encoder.output_columns] for r in out.select("id", *encoder.output_columns).collect()}
    assert all(sum(rows[i]) == 1 for i in (1, 2, 3)) and sum(rows[4]) == 0
    many = spark.range(12_000).select("id", F.format_string("v%05d", "id").alias("c"))
    sparse = prepare.one_hot_sparse(many, ["c"]).where("id in (0, 11999)").orderBy("id").collect()
    assert [list(r["c_onehot"].indices) for r in sparse] == [[0], [11999]]
