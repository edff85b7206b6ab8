"""Whitening, removal of repeated passages and the Merkle manifest against plain versions."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import empty_docs, hard_docs, sf_docs, words
from pyspark.sql import functions as F

from tauframe.llm import catalog, merkle, substring_dedup, whitening


def matrices():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((8, 8)))[0]
    z = rng.standard_normal((500, 40)) * np.linspace(1, 9, 40)
    return {
        "repeated": np.diag([1.0, 1, 1, 5]), "zero among others": np.diag([0.0, 1, 2]), "identity": np.eye(5),
        "nothing": np.zeros((3, 3)), "far apart": np.diag([1e-3, 1e6, 1, 1]), "one": np.array([[7.0]]),
        "clusters": turn @ np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]) @ turn.T, "full": z.T @ z / 500, "low rank": z[:9].T @ z[:9]}


@pytest.mark.parametrize("name", sorted(matrices()))
def test_divide_and_conquer_equals_the_dense_solver(name):
    a = matrices()[name]
    values, vectors = whitening.spectral_components(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * scale
    assert np.linalg.norm(vectors.T @ vectors - np.eye(len(a))) <= 1e-13


def test_polar_factor_has_the_signs_of_the_eigenvalues():
    a = matrices()["full"] - 30 * np.eye(40)
    e, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-12


def test_whitening_of_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = catalog.op11_whitening(spark, "/root/testdata/sf0.01").toPandas()
    rows = table.select("vec_id", "embedding").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], dtype=np.float64)) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    e, v = np.linalg.eigh((x - total / n).T @ (x - total / n) / n)
    e, v = e[::-1][:32], v[:, ::-1][:, :32]
    want = (x - total / n) @ v / np.sqrt(e)
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    sign = np.sign((z * want).sum(axis=0))
    assert z.shape == (n, 32) and np.abs(z * sign - want).max() < 1e-7
    spread = np.linalg.eigvalsh(np.cov(x.T, bias=True)).sum()
    first = got[got.vec_id == rows[0]["vec_id"]].sort_values("component")
    assert np.allclose(first.explained, e / spread, rtol=1e-9) and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    ints = [[int(c) for c in r] for r in x]
    sums = [int(t) for t in total]
    want_dev = {r["vec_id"]: sum((n * a - s) ** 2 for a, s in zip(i, sums)) for r, i in zip(rows, ints)}
    assert dict(zip(got.vec_id, got.deviation)) == want_dev


def test_unusable_vectors_are_left_out(spark):
    rows = [
        (1, [0.5, 1.5], 1), (2, [1.0, -1.0], 2), (2, [1.0, -1.0], 2), (3, None, 3), (4, [None, 1.0], 4), (5, [], 5),
        (6, [float("nan"), 1.0], 6), (7, [float("inf"), 0.0], 7), (8, [1.0, 2.0, 3.0], 8), (None, [0.25, 0.125], None),
        (9, [3.0e30, 0.0], 9)]
    df = spark.createDataFrame(rows[:-1], "vec_id long, embedding array<float>, _at int")
    got = whitening.whitened_components(df).toPandas()
    assert sorted(got.vec_id.fillna(-1).astype(int)) == [-1, -1, 1, 1, 2, 2, 2, 2] and (got.n == 4).all()
    whitening.whitened_components(spark.createDataFrame(rows, df.schema)).collect()
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0])], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whitened_components(same).collect()} == {1}  # one dimension is constant
    assert whitening.whitened_components(df.filter("false")).collect() == []
    assert whitening.whitened_components(df.filter("vec_id = 3")).collect() == []


def plain_cut(rows, k):
    docs = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[j:j + k]) for _, w in docs for j in range(len(w) - k + 1))
    for i, w in docs:
        gone = set()
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j:j + k])] > 1:
                gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def cut(df, k):
    got = substring_dedup.repeated_spans(df, k)
    return got, [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


@pytest.mark.parametrize("docs, k", [(hard_docs, 35), (hard_docs, 3), (hard_docs, 1), (sf_docs, 35), (sf_docs, 6), (empty_docs, 35)])
def test_repeated_passages_equal_brute_force(spark, docs, k):
    df = docs(spark)
    assert Counter(cut(df, k)[1]) == Counter(plain_cut([tuple(r) for r in df.select("doc_id", "text").collect()], k))


def test_passages_at_all_places_and_lengths(spark):
    import random

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 47, 80, 300)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            low = rng.randrange(max(1, len(p) - 30))
            text += [word() for _ in range(rng.randrange(20))] + p[low:] + [word() for _ in range(rng.randrange(3))]
        rows.append((i, "  ".join(text) if i % 2 else "\n".join(text)))
    rows += [(200 + i, " ".join(passages[1])) for i in range(300)] + [(600, "go " * 90)]
    got, found = cut(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    assert Counter(found) == Counter(plain_cut(rows, 35))
    for r in got.collect():
        assert sum(r["ends"]) - sum(r["starts"]) == r["n_removed"]
        assert all(b - a >= 35 for a, b in zip(r["starts"], r["ends"]))


def test_hot_anchors_take_the_broadcast_side(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", 20)
    rows = [(i, " ".join(f"p{j}" for j in range(60)) + f" own{i}") for i in range(80)]
    rows += [(100 + i, " ".join(f"q{i % 9}x{j}" for j in range(50))) for i in range(18)]
    assert Counter(cut(spark.createDataFrame(rows, "doc_id long, text string"), 35)[1]) == Counter(plain_cut(rows, 35))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, k):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + k]) for i in range(0, len(out[-1]), k)])
    return out


def path_of(levels, i, k):
    for level in levels[:-1]:
        low = i // k * k
        yield level[low:i], level[i + 1:low + k]
        i //= k


def plain_manifest(rows, k):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(*map(field, r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sorted_ = {g: sorted(groups[g], key=lambda x: x[:3]) for g in order}
    trees = {g: levels_of([x[2] for x in sorted_[g]], k) for g in order}
    top = levels_of([trees[g][-1][0] for g in order], k)
    for j, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted_[g]):
            proof = [*path_of(trees[g], i, k), *path_of(top, j, k)]
            own = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                own = H(*map(field, (*r[:3], r[3] + 1, r[4])))
            for before, after in proof:
                own = H(*before, own, *after)
            root = top[-1][0]
            yield r[0], leaf, trees[g][-1][0], root, H(*[h for a, b in proof for h in a + b]), own, own == root


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(df, k):
    seventh = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("doc_id").isNotNull()
    leaves = df.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("id"), merkle.leaf_digest([F.col(c) for c in COLUMNS]).alias("leaf"),
        F.when(seventh, merkle.leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])).alias("shown"))
    got = merkle.manifest(leaves, k, ["shown"]).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"),
        merkle.fold(F.coalesce("shown", "leaf"), F.col("proof")).alias("f"))
    return [tuple(r) for r in got.withColumn("v", F.col("f") == F.col("root")).collect()]


@pytest.mark.parametrize("docs, k", [(hard_docs, 2), (hard_docs, 3), (sf_docs, 2), (sf_docs, 16), (empty_docs, 2)])
def test_manifest_equals_plain_trees(spark, docs, k):
    df = docs(spark)
    want = list(plain_manifest([tuple(r) for r in df.select(*COLUMNS).collect()], k))
    assert Counter(manifest(df, k)) == Counter(want)
    if docs is sf_docs:
        assert {w[6] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_one_group_of_any_size(spark, n):
    rows = [(i, None, "en", i, f"t{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(manifest(df, 2)) == Counter(plain_manifest(rows, 2))
