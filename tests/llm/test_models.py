"""Classifier, language model, quality rules and segmentation against plain Python."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from corpus import empty_docs, hard_docs, hard_rows, sf_docs, words

from tauframe.llm import catalog, quality_classifier, quality_rules, suffix_tree
from tauframe.llm import sentencepiece_sampling as pieces
from tauframe.llm.textvec import shingle_sets, words_of

SF = "/root/testdata/sf0.01"


def crc(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def test_classifier_held_out_accuracy(spark):
    got = catalog.op4_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: crc(i, 5) == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    bag, x, y = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0])
    model = quality_classifier.train(bag, x, y, hidden=4, attention=3, epochs=3)

    def loss():
        p = model.score(bag, x, 3)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in model.gradients(bag, x, y).items():
        weight = model.weights[name]
        for at in np.ndindex(weight.shape):
            old = weight[at]
            weight[at] = old + 1e-6
            up = loss()
            weight[at] = old - 1e-6
            down = loss()
            weight[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-5


def test_classifier_hard_cases(spark):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(16)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(hard_docs(spark), labels, catalog.id_remainder("doc_id", 5) != 0)
    got = quality_classifier.score(hard_docs(spark), model).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.score <= 1 for r in got)
    kept = quality_classifier.keep_good(hard_docs(spark), model, 0.0)
    assert kept.columns == hard_docs(spark).columns and kept.count() == len(hard_rows())
    none = quality_classifier.fit(empty_docs(spark), labels, catalog.id_remainder("doc_id", 5) != 0)
    assert {r.score for r in quality_classifier.score(hard_docs(spark), none).collect()} == {0.5}
    assert quality_classifier.score(empty_docs(spark), model).count() == 0


def test_classifier_sample_keeps_long_documents(spark, monkeypatch):
    """Beyond the bound, documents are taken by id hash, whatever their length."""
    rows = [(i, " ".join(["word"] * (640 if i % 2 else 10))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda bag, x, y: seen.append(np.bincount(bag)))
    quality_classifier.fit(docs, labels, catalog.id_remainder("doc_id", 5) >= 0, max_passages=100)
    order = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    upto = np.cumsum([10 if i % 2 else 1 for i in order])
    assert seen[0].tolist() == [10 if i % 2 else 1 for i in sorted(np.array(order)[upto <= 100])]
    assert 10 in seen[0]


def plain_counts(rows):
    counts, tokens = Counter(), {}
    for i, t in rows:
        tokens.setdefault((i, t), [*words(t, lower=True), None])
        if crc(i, 7) != 2:
            counts.update(tokens[i, t])
    return counts, tokens


def test_base_scores(spark):
    rows = [(r.doc_id, r.text) for r in sf_docs(spark).collect()]
    counts, tokens = plain_counts(rows)
    n, v, texts = sum(counts.values()), len(counts), dict(rows)
    got = catalog.op8_lm_scoring(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id, texts[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(t), n)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)


def corpus_with_habits(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        out = ["go"]
        for _ in range(80):
            last = out[-1]
            follow = {"go": ["a", "b"], "a": ["b"] * 8 + ["c"], "b": ["a", "c", "c", "c"], "c": ["a", "b", "go"]}[last]
            out.append(follow[rng.integers(len(follow))] if rng.random() > 0.1 else f"w{rng.integers(60)}" if rng.random() < 0 else "abc"[rng.integers(3)])
        rows.append((i, " ".join(out)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("head_share", [1e-6, 0.3])
def test_suffix_tree_scores(spark, head_share):
    """States are found, distributions sum to one, scores follow the longest state."""
    docs = corpus_with_habits(spark)
    tree, counts = suffix_tree.fit(suffix_tree.train_rows(docs, catalog.id_remainder("doc_id", 7) != 2))
    assert len(tree.levels) >= 1 and len(tree.levels[0].context) >= 2
    symbols = tree.head
    for level in range(len(tree.levels)):
        for context in tree.levels[level].context[:5]:
            candidates = [c for c in np.ndindex(*([len(symbols)] * (level + 1))) if suffix_tree.context_key(tuple(int(symbols[i]) for i in c)) == context]
            history = symbols[list(candidates[0])]
            logs = []
            for s in symbols:
                line = np.append(history, s)
                logs.append(suffix_tree.token_logs(tree, line, np.zeros(len(line), np.int64))[2][-1])
            # All known symbols and the share of an unseen one under the same state.
            unseen = np.append(history, np.uint64(12345))
            rest = suffix_tree.token_logs(tree, unseen, np.zeros(len(unseen), np.int64))[2][-1]
            assert abs(sum(10**x for x in logs) + 10**rest - 1) < 1e-6
    scored = suffix_tree.score(docs, tree, counts).toPandas()
    assert scored.score.sum() > scored.base_score.sum() * 0.9


def test_tail_counts_do_not_change_scores(spark):
    docs = sf_docs(spark)
    train = suffix_tree.train_rows(docs, catalog.id_remainder("doc_id", 7) != 2)
    results = []
    for share in (1e-6, 1e-4):
        tree, counts = suffix_tree.fit(train, head_share=share, min_share=5e-2)
        results.append(suffix_tree.score(docs, tree, counts).orderBy("doc_id").toPandas())
    np.testing.assert_allclose(results[0].score, results[1].score, rtol=1e-9)
    assert (results[0].n_known == results[1].n_known).all()


def test_contexts_are_admitted_by_count(spark):
    """A context of a vanishing share of the corpus is a state, and broadcasts change no score."""
    rows = [r.text for r in corpus_with_habits(spark).collect()] + ["rare one two go a b c"] * 9
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    train = docs.select("text")
    one, counts = suffix_tree.fit(train)
    key = suffix_tree.context_key((int(suffix_tree.tokens(pa.array(["rare"]))[0][0]),))
    assert key in one.levels[0].context and 9 / one.total < 5e-4 and one.tail is None
    two, _ = suffix_tree.fit(train, head_share=2e-2, head_rows=2)
    assert two.tail is not None and len(two.levels[0].context) <= 2
    three, _ = suffix_tree.fit(train, head_rows=0)
    wanted = suffix_tree.score(docs, one, counts).orderBy("doc_id").toPandas()
    for tree in (two, three):
        got = suffix_tree.score(docs, tree, counts).orderBy("doc_id").toPandas()
        assert (got.n_known == wanted.n_known).all()
        np.testing.assert_allclose(got.score, wanted.score, rtol=1e-9)
        np.testing.assert_allclose(got.base_score, wanted.base_score, rtol=1e-9)


def test_lm_hard_cases(spark):
    docs = hard_docs(spark)
    tree, counts = suffix_tree.fit(suffix_tree.train_rows(docs, catalog.id_remainder("doc_id", 7) != 2))
    got = suffix_tree.score(docs, tree, counts).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(words(r[1])) + 1 for r in hard_rows())
    assert all(r.score < 0 for r in got)
    tree, counts = suffix_tree.fit(suffix_tree.train_rows(empty_docs(spark), catalog.id_remainder("doc_id", 7) != 2))
    assert suffix_tree.score(empty_docs(spark), tree, counts).count() == 0
    assert all(r.n_known == 0 for r in suffix_tree.score(docs, tree, counts).collect())


def plain_rules(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("docs", [hard_docs, sf_docs])
def test_rule_counts(spark, docs):
    df = docs(spark)
    expected = sorted((-1 if r.doc_id is None else r.doc_id, *plain_rules(r.text)) for r in df.collect())
    got = quality_rules.judge(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in quality_rules.COUNTS[:5])) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_and_drop_junk(spark):
    got = quality_rules.judge(sf_docs(spark, "sf0.01")).toPandas()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    good = both[(both.quality == 1) & ~both.base_failed]
    assert good.kept.mean() > 0.98
    assert both[both.quality == 0].kept.mean() < 0.3
    assert quality_rules.judge(empty_docs(spark)).count() == 0


def rule_rows(values, source):
    return [(i, "en", source, 100, int(v), 0, 0, 0, 0, 1) for i, v in enumerate(values)]


def rule_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))


def test_quantiles_of_merged_sketches(spark):
    values = np.random.default_rng(2).integers(40, 900, 3000)
    counts = rule_table(spark, rule_rows(values[:1800], "a") + rule_rows(values[1800:], "b"))
    got = quality_rules.quantiles(quality_rules.sketches(counts), ["lang"], 0.9).filter("ratio = 'word_length'").first()
    for found, q in ((got.low, 0.1), (got.mid, 0.5), (got.high, 0.9)):
        assert abs(found / np.quantile(values / 100, q) - 1) < 0.03


def test_bounds_follow_their_group(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(400, 600, 2000), rng.integers(400, 600, 2000)

    def bounds(b):
        limits = quality_rules.thresholds(rule_table(spark, rule_rows(a, "a") + rule_rows(b, "b")), 0.9, 3.0, 0)
        return {r.source: (r.word_length_least, r.word_length_most) for r in limits.collect()}

    before, wider, higher = bounds(b), bounds((b - 500) * 2 + 500), bounds(b + 300)
    assert before["a"] == wider["a"] == higher["a"]
    assert wider["b"][1] > before["b"][1] + 1 and wider["b"][0] < before["b"][0]
    assert higher["b"][1] > before["b"][1] + 2.5 and higher["b"][0] > before["b"][0] + 2.5


def test_verdicts_match_exact_quantiles(spark):
    """Only texts within the sketch's error of a bound may be judged otherwise."""
    got = quality_rules.judge(sf_docs(spark, "sf0.01")).toPandas()
    chance, surely, maybe = 3.0, ~got.base_failed, ~got.base_failed
    lang, group = got.lang.fillna("?"), [got.lang.fillna("?"), got.source.fillna("?")]
    size = got.groupby(group).doc_id.transform("size")
    for above, below, two_sided in quality_rules.RATIOS.values():
        count, base = got[above], got[below]
        ratio = (count / base.where(base > 0, 1)).where(base > 0, 0.0)
        low, mid, high = (
            (ratio.groupby(group).transform(lambda x, q=q: np.quantile(x, q, method="inverted_cdf")) * size
             + ratio.groupby(lang).transform(lambda x, q=q: np.quantile(x, q, method="inverted_cdf")) * 100) / (size + 100)
            for q in (0.1, 0.5, 0.9))
        for error, sure in ((-0.07, True), (0.07, False)):
            most = (mid + 3 * (high - mid)) * (1 + error) * base
            inside = count <= most + chance * np.sqrt(most + chance**2 / 4) + chance**2 / 2
            if two_sided:
                least = (mid - 3 * (mid - low)).clip(lower=0) * (1 - error) * base
                inside &= count >= least - chance * np.sqrt(least)
            if sure:
                surely &= inside
            else:
                maybe &= inside
    assert (got.kept | ~surely).all() and (~got.kept | maybe).all()
    assert (maybe & ~surely).mean() < 0.02 and surely.mean() > 0.5


def test_segmentations_are_lossless(spark):
    got = catalog.sampled_pieces(hard_docs(spark)).collect()
    assert len(got) == len(hard_rows()) and all(r.lossless for r in got)
    assert all((r.piece_ids is None) == (r.text is None) for r in got)
    strange = ["▁x ▁▁ y", "日本語 ꙮ \t\x00", " lead", "trail ", "\n\n a\r\nb", "a b", "🙂🙃 ok"]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert all(r.lossless for r in catalog.sampled_pieces(df).collect())
    assert catalog.sampled_pieces(empty_docs(spark)).count() == 0


def test_segmentations_depend_on_key_and_seed_only(spark):
    docs = sf_docs(spark).select("doc_id", "text")
    run = lambda df, seed=17: {r.doc_id: tuple(r.piece_ids) for r in pieces.encode(df, alpha=0.2, seed=seed).collect()}
    one = run(docs.coalesce(1))
    assert one == run(docs.repartition(7))
    assert sum(one[i] != x for i, x in run(docs, 18).items()) > 0.9 * len(one)


def test_draws_follow_all_paths():
    model = pieces.Pieces.load()
    trie, n, word = pieces.Trie(model), 20_000, b" then"
    ids, count = pieces.sample(pa.array([word[1:].decode()] * n), np.arange(n), model, trie, 0.5, 3)
    edges = np.concatenate(([0], np.cumsum(count)))
    seen = Counter(tuple(ids[edges[i] : edges[i + 1]]) for i in range(n))
    bytes_of = set(model.byte_id.tolist())
    known = {s: i for i, s in enumerate(model.surface) if s is not None and i not in bytes_of}
    paths = {}

    def walk(rest, path, weight):
        if not rest:
            paths[tuple(path)] = weight
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                i = known[rest[:k]]
                walk(rest[k:], [*path, i], weight * (1 + model.rank[i]) ** -0.5)

    walk(word, [], 1.0)
    total = sum(paths.values())
    assert set(seen) <= set(paths)
    for path, weight in paths.items():
        p = weight / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_lattices_of_long_texts_are_few_at_once(monkeypatch):
    """Memory follows the slice, not the text, and slices change no draw."""
    model = pieces.Pieces.load()
    trie = pieces.Trie(model)
    assert sum(x.nbytes for x in vars(trie).values()) < 16e6
    rng = np.random.default_rng(8)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10**9, 150_000)), "", " a  b ", "é" * 50])
    draw = lambda: pieces.sample(texts, np.arange(len(texts)), model, trie, 0.5, 3)
    tracemalloc.start()
    ids, count = draw()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and count.sum() == len(ids)
    for name, value in (("SLICE_BYTES", 70_000), ("LATTICE_BYTES", 3_000)):
        monkeypatch.setattr(pieces, name, value)
        again = draw()
        assert (again[0] == ids).all() and (again[1] == count).all()
    table = pa.array([x or b"" for x in model.surface], pa.binary())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), table.take(pa.array(ids)))
    assert pieces._without_first(pc.binary_join(lists, b"")).to_pylist() == texts.to_pylist()


def test_word_vectors():
    texts = [r[1] or "" for r in hard_rows()]
    for lower in (False, True):
        w = words_of(pa.array(texts), lower)
        found = defaultdict(list)
        for d, s, e in zip(w.doc, w.start, w.end):
            found[d].append(bytes(w.data[s:e]).decode())
        assert [found[i] for i in range(len(texts))] == [words(t, lower) for t in texts]
    doc, shingle = shingle_sets(words_of(pa.array(texts), True), 3)
    for i, t in enumerate(texts):
        w = words(t, True)
        plain = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}
        assert (doc == i).sum() == len(plain)


def test_gram_counts_match_plain(spark):
    """Runs of symbols travel as places in the head or whole; both are counted exactly."""
    rows = [r.text for r in corpus_with_habits(spark).collect()] + ["rare one two go a b c"] * 9 + [None, "", "go"]
    train = spark.createDataFrame([(r,) for r in rows], "text string").repartition(5)
    everything = np.full(1 << (suffix_tree.CELL_BITS - 6), 2**64 - 1, np.uint64)
    lines = [[int(x) for x in suffix_tree.tokens(pa.array([r or ""]))[0]] for r in rows]
    symbols = np.array(sorted({x for line in lines for x in line}), np.uint64)
    for length in (1, 2):
        want = Counter(tuple(line[i : i + length + 1]) for line in lines for i in range(len(line) - length))
        want = {k: n for k, n in want.items() if n >= suffix_tree.MIN_COUNT}
        for head in (symbols, symbols[::2], symbols[:0]):
            got = suffix_tree.gram_counts(train, length, everything, head).collect()
            assert {tuple(x % 2**64 for x in r[:-1]): r.n for r in got} == want and len(got) == len(want)


def test_lookups_add_up_without_a_row_a_token(spark):
    """A lookup row has no column for each kind of lookup, and nothing is grouped by token."""
    docs = corpus_with_habits(spark)
    tree, counts = suffix_tree.fit(docs.select("text"), head_share=2e-2, head_rows=0)
    scored = suffix_tree.score(docs, tree, counts)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert " pos" not in plan and plan.count("Aggregate [") == 1
    assert len(suffix_tree.SCORED.split("<")[0].split(", ")) == 4


def test_cells_hold_all_frequent_runs_and_few_others(spark):
    """The first pass loses no run that is frequent, spares nearly all that are not, and travels small."""
    rng = np.random.default_rng(5)
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 300, 2000)) for _ in range(20)] + ["rare one two"] * 8 + ["rare one"] * 7 + [None, ""]
    train = spark.createDataFrame([(r,) for r in rows], "text string").repartition(7)
    everything = np.full(1 << (suffix_tree.CELL_BITS - 6), 2**64 - 1, np.uint64)
    lines = [suffix_tree.tokens(pa.array([r or ""]))[0] for r in rows]
    for length in (1, 2):
        plain = Counter(tuple(line[i : i + length + 1]) for line in lines for i in range(len(line) - length))
        key = suffix_tree.row_keys(np.array(list(plain), np.uint64))
        frequent = np.array([n >= suffix_tree.MIN_COUNT for n in plain.values()])
        wanted = suffix_tree.gram_cells(train, length, everything, sum(map(len, lines)))
        marked = suffix_tree.in_cells(wanted, key)
        assert marked[frequent].all() and frequent.any() and marked[~frequent].mean() < 0.01
        got = suffix_tree.gram_counts(train, length, everything, np.zeros(0, np.uint64), wanted).collect()
        assert {tuple(x % 2**64 for x in r[:-1]): r.n for r in got} == {
            tuple(int(x) for x in k): n for k, n in plain.items() if n >= suffix_tree.MIN_COUNT}
    cell = np.unique(rng.integers(0, 1 << 29, 1 << 20, dtype=np.uint64))
    packed = suffix_tree._packed_cells(cell, np.uint64(35), 8)
    assert sum(len(x) for planes in packed.column("planes").to_pylist() for x in planes) < 2 * len(cell)


def test_lookups_travel_packed(spark):
    """A lookup costs less than the 16 bytes of its key and row, and comes back to its own text."""
    rng = np.random.default_rng(6)
    key, row = rng.integers(0, 2**64, 200_000, dtype=np.uint64), np.sort(rng.integers(10**6, 10**6 + 5000, 200_000))
    packed = suffix_tree._packed_lookups(3, key, row, 10)
    assert sum(len(x) for planes in packed.column("planes").to_pylist() for x in planes) < 10 * len(key)
    back = [suffix_tree._of_planes(n, planes) for n, planes in zip(packed.column("size").to_pylist(), packed.column("planes").to_pylist())]
    order = np.lexsort((row, key))
    assert (np.concatenate([x for x, _ in back]) == key[order]).all()
    assert (np.concatenate([x for _, x in back]).astype(np.int64) + packed.column("row")[0].as_py() == row[order]).all()
    docs = corpus_with_habits(spark)
    tree, counts = suffix_tree.fit(docs.select("text"), head_share=2e-2, head_rows=0)
    assert "Join" not in suffix_tree.score(docs, tree, counts)._jdf.queryExecution().optimizedPlan().toString()
