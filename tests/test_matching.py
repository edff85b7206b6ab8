"""Matching against the sequential definition, written from scratch here."""

import random

import pytest
from pyspark.sql import functions as F

from tauframe.operators import describe, matching
from tauframe.spec import CausalSpec

SPEC = CausalSpec("id", "t", "y")
SCHEMA = "id long, t int, ps double, g string"


def brute_neighbours(rows, k):
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    place = {r[0]: i for i, r in enumerate(order)}
    out = {}
    for r in rows:
        if r[1] == 1:
            ranked = sorted(
                order, key=lambda o: (abs(o[2] - r[2]), abs(place[o[0]] - place[r[0]]), place[o[0]])
            )
            out[r[0]] = ranked[:k]
    return out


def brute_greedy(rows, k, reuse=False):
    near, used, out = brute_neighbours(rows, k), set(), {}
    for unit in sorted(near):
        for o in near[unit]:
            if o[1] == 0 and (reuse or o[0] not in used):
                used.add(o[0])
                out[unit] = o[0]
                break
    return out


def sample(seed, n, scale, treated=0.5):
    rng = random.Random(seed)
    return [
        (i, int(rng.random() < treated), round(rng.random() * scale) / scale, rng.choice("abc"))
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs_of(df):
    return {r["id"]: r["matched_id"] for r in df.collect()}


@pytest.mark.parametrize("seed,n,scale,treated", [
    (1, 300, 1000, 0.5), (2, 300, 7, 0.5), (3, 250, 1, 0.7), (4, 9, 100, 0.4), (5, 200, 10**6, 0.3),
])
@pytest.mark.parametrize("block", [12, 5000])
def test_greedy_equals_sequential(spark, seed, n, scale, treated, block):
    rows = sample(seed, n, scale, treated)
    got = matching.match_without_replacement(frame(spark, rows), SPEC, "ps", k=10, block_rows=block)
    assert pairs_of(got) == brute_greedy(rows, 10)


def test_greedy_when_ids_follow_the_score(spark):
    # Every unit displaces the next: the longest chain of proposals there is.
    rows = [(i, 1 - i % 2, i / 1000.0, "a") for i in range(400)]
    got = matching.match_without_replacement(frame(spark, rows), SPEC, "ps", k=6, block_rows=20)
    assert pairs_of(got) == brute_greedy(rows, 6)


def test_with_replacement_and_neighbours(spark):
    rows = sample(6, 300, 20)
    df = frame(spark, rows)
    got = matching.match_with_replacement(df, SPEC, "ps", k=10, block_rows=15)
    assert pairs_of(got) == brute_greedy(rows, 10, reuse=True)
    near = {}
    for r in matching.neighbour_pairs(df, SPEC, "ps", 10, block_rows=11).collect():
        near.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    want = {u: {i + 1: o[0] for i, o in enumerate(v)} for u, v in brute_neighbours(rows, 10).items()}
    assert near == want


def test_stratified_runs_inside_each_level(spark):
    rows = sample(7, 400, 50)
    rows += [(1000 + i, 1, 0.5, "no_control") for i in range(5)] + [(2000, 1, 0.5, None), (2001, 0, 0.5, None)]
    spec = CausalSpec("id", "t", "y", stratum="g")
    got = matching.match_by_stratum(frame(spark, rows), spec, "ps", k=8, block_rows=30)
    want = {}
    for level in "abc":
        want.update(brute_greedy([r for r in rows if r[3] == level], 8))
    assert pairs_of(got) == want


def test_pairs_are_one_to_one_and_within_caliper(spark):
    rows = sample(8, 300, 1000)
    df = frame(spark, rows)
    got = matching.match_without_replacement(df, SPEC, "ps", ratio=0.002, enforce_caliper=True).collect()
    assert len({r["matched_id"] for r in got}) == len(got)
    mean = sum(r[2] for r in rows) / len(rows)
    sd = (sum((r[2] - mean) ** 2 for r in rows) / len(rows)) ** 0.5
    assert got and all(r["gap"] <= sd * 0.002 + 1e-12 for r in got)


def test_balance_from_copies_equals_the_exploded_sample(spark):
    """Values far from zero, a constant feature, nulls and controls used many times."""
    rows = [(i, int(i % 7 == 0), (i * 37 % 101) / 101, "a") for i in range(400)]
    df = frame(spark, rows).withColumns({
        "big": 1e6 + F.col("ps"), "flat": F.lit(2.0), "holes": F.when(F.col("id") % 3 != 0, F.col("ps") * 5)})
    pairs = matching.match_with_replacement(df, SPEC, "ps", k=10)
    treat, features = SPEC.treatment, ["ps", "big", "flat", "holes"]
    got = describe.balance_before_after(df, matching.pair_copies(pairs, "id"), "id", treat, features)
    got = {(r.matching, r.feature): r for r in got.collect()}
    for label, sample in (("before", df), ("after", matching.matched_sample(df, pairs, "id"))):
        sizes = {r.feature: r for r in describe.feature_moments(sample, treat, features).collect()}
        for r in describe.balance_table(sample, treat, features).collect():
            mine = got[label, r.feature]
            assert (mine.n_treatment, mine.n_control) == (sizes[r.feature].n1, sizes[r.feature].n0)
            for a, b in ((mine.smd, r.smd and abs(r.smd)), (mine.p_value, r.p_value)):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)


def test_matched_sample_keeps_repeated_controls(spark):
    df = frame(spark, [(1, 1, 0.5, "a"), (2, 1, 0.5, "a"), (3, 0, 0.5, "a"), (4, 0, 0.9, "a")])
    pairs = matching.match_with_replacement(df, SPEC, "ps", k=3)
    sample_ids = sorted(r["id"] for r in matching.matched_sample(df, pairs, "id").collect())
    assert sample_ids == [1, 2, 3, 3]
    attached = {r["id"]: r["matched_id"] for r in matching.attach_match(df, pairs, "id").collect()}
    assert attached == {1: 3, 2: 3, 3: None, 4: None}
