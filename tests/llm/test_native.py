"""Sharding, exact deduplication, mixing and personal data against plain Python."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpus import empty_docs, hard_docs, hard_rows, sf_docs, words

from pyspark.sql import functions as F
from tauframe.llm import catalog, exact_dedup, mixing, pii, sharding


def rows_of(df, *names):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("docs", [hard_docs, sf_docs])
@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_balanced_runs(spark, docs, shards):
    df = docs(spark)
    source = rows_of(df)
    got = sharding.shard_by_bytes(df, shards).toPandas()
    size = lambda t: len((t or "").encode()) + 8
    expected = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in source)
    found = Counter((None if i != i else int(i), int(s), int(c)) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    assert found == expected
    assert got["shard"].between(0, shards - 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    total, largest = got["size"].sum(), got["size"].max()
    for _, part in got.groupby("shard"):
        assert part["size"].sum() <= total / shards * 1.004 + largest
    # Contiguous: what precedes a shard in the order of bytes is what lies in earlier shards.
    sums = got.groupby("shard")["size"].sum().cumsum().shift(1, fill_value=0)
    first = got.groupby("shard")["shard_first_byte"].first()
    assert (sums == first).all()


def test_small_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 2} " + "x" * 500) for i in range(4000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 7, whole_share=0.01).toPandas()
    assert (got.assign(g=got.doc_id // 2).groupby("g")["shard"].nunique() == 1).all()


def test_a_huge_group_is_split(spark):
    rows = [(i, "same") for i in range(900)] + [(i, f"own {i}") for i in range(900, 1200)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 6 and sums.max() - sums.min() < 40


def plain_groups(source, keep):
    groups = defaultdict(list)
    for i, t in source:
        groups[t or ""].append(i)
    pick = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        pick[t] = (max if keep == "largest" else min)(known) if known else None
    return groups, pick


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256_text, lambda t: F.length(t).cast("string")])
def test_exact_groups(spark, keep, digest):
    """Also with a digest that collides all the time: bytes decide."""
    source = [(r[0], r[1]) for r in hard_rows()]
    got = exact_dedup.exact_duplicates(hard_docs(spark), keep=keep, digest=digest).collect()
    groups, pick = plain_groups(source, keep)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(source)
    kept = Counter()
    for r in got:
        t = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (pick[t], len(groups[t]))
        if r.kept:
            kept[t] += 1
            assert r.doc_id == pick[t]
    assert kept == Counter(groups.keys())


def test_exact_drop_keeps_columns(spark):
    left = exact_dedup.drop_exact_duplicates(hard_docs(spark))
    assert left.columns == hard_docs(spark).columns
    texts = [r.text or "" for r in left.select("text").collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in hard_rows()})


def test_exact_streams_many_files(spark):
    got = exact_dedup.exact_duplicates(sf_docs(spark).repartition(9), files_per_trigger=2).collect()
    groups, pick = plain_groups(rows_of(sf_docs(spark)), "largest")
    assert sum(r.kept for r in got) == len(groups)


def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, target = set(order), sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if most * sizes[s] < level * weight[s]]
        for s in over or list(free):
            target[s] = most * sizes[s] if over else level * weight[s]
            free.discard(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("docs", [hard_docs, sf_docs])
@pytest.mark.parametrize("weights", [[5, 2, 1], [40, 1]])
def test_mix_meets_targets(spark, docs, weights):
    df = docs(spark)
    source = {(r["doc_id"], r["text"]): r["source"] for r in df.select("doc_id", "text", "source").collect()}
    block = 4
    got = mixing.mix_sources(df, weights, 3, block).toPandas()
    sizes = Counter()
    for r in df.select("text", "source").collect():
        sizes[r["source"]] += len(words(r["text"]))
    target = plain_targets(sizes, weights, 3)
    assert len(got) == df.count() and (got.taken <= 3 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len(words(t)) for _, t in rows_of(df))
    by = got.groupby(["source_size", "target"])["taken"].sum()
    for (size, goal), taken in by.items():
        assert any(abs(goal - target[s]) < 1e-6 and size == sizes[s] for s in sizes)
    if docs is sf_docs:
        ids = {i: s for (i, _), s in source.items()}
        taken = got.assign(source=got.doc_id.map(ids)).groupby("source").agg(t=("taken", "sum"), g=("target", "first"))
        assert (abs(taken.t - taken.g) <= 6 * block).all()


def test_mix_is_the_same_for_any_partitioning(spark):
    one = mixing.mix_sources(sf_docs(spark).coalesce(1), [5, 2, 1]).select("doc_id", "taken").collect()
    many = mixing.mix_sources(sf_docs(spark).repartition(13), [5, 2, 1]).select("doc_id", "taken").collect()
    assert sorted(one) == sorted(many)


def test_tiny_sources_meet_their_targets(spark):
    """Sources of 1 to 40 words beside a large one."""
    sizes = {f"s{n:02d}": n for n in (1, 2, 5, 10, 40)} | {"zz": 60_000}
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate(sizes.items())]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), [5, 2, 1]).collect()
    target = plain_targets(sizes, [5, 2, 1], 3)
    for r in got:
        goal = target[rows[r.doc_id][1]]
        assert abs(r.target - goal) < 1e-6 and abs(r.taken - goal) <= max(2, 0.05 * goal)


def test_golden_points(spark):
    slots = [0, 1, 2, 2**31 - 1, 2**31, 2**31 + 1, 10**12, 2**45 + 12345]
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select(
        "slot", mixing.golden_point(F.col("slot")).alias("point")).collect()
    assert all(r.point == r.slot * mixing.GOLDEN_STEP % 2**62 for r in got)


def plain_mix(rows, weights, most, block):
    """(row number, slot) of every whole document of the mix, by the definition."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = plain_targets(sizes, weights, most)
    order = [s for s in sorted(sizes, key=lambda s: (s is None, s or "")) if target[s] > 0]
    blocks = {s: max(-(-sizes[s] // block), min(sizes[s], 64)) for s in order}
    need = [target[s] * blocks[s] / sizes[s] for s in order]
    edges = [round(sum(need[:i + 1]) / sum(need) * 2**62) for i in range(len(need) - 1)] + [2**62]
    turns, taken = Counter(), defaultdict(list)
    for slot in range(math.ceil(sum(need))):
        point = slot * mixing.GOLDEN_STEP % 2**62
        s = order[next(i for i, e in enumerate(edges) if point < e)]
        if turns[s] < most * blocks[s]:
            taken[s, turns[s] % blocks[s]].append(slot)
        turns[s] += 1
    out = []
    for s in order:
        at, start = 0, [b * (sizes[s] // blocks[s]) + min(b, sizes[s] % blocks[s]) for b in range(blocks[s])]
        mine = [(i, r) for i, r in enumerate(rows) if r[2] == s]
        for i, r in sorted(mine, key=lambda x: hashlib.md5(str(x[1][0]).encode()).hexdigest()):
            if words(r[1]):
                out += [(i, slot) for slot in taken[s, bisect.bisect_right(start, at) - 1]]
                at += len(words(r[1]))
    return sorted(out, key=lambda x: x[1])


def test_mixed_documents_follow_the_schedule(spark):
    docs = sf_docs(spark).select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    expected = [rows[i][0] for i, _ in plain_mix(rows, [5, 2, 1], 3, 32)]
    got = [r.doc_id for r in mixing.mixed_documents(docs, [5, 2, 1]).collect()]
    assert Counter(got) == Counter(expected) and len(got) == len(expected)
    slots = dict()
    for i, slot in plain_mix(rows, [5, 2, 1], 3, 32):
        slots.setdefault(rows[i][0], []).append(slot)
    seen, order = Counter(), []
    for d in got:
        order.append(slots[d][seen[d]])
        seen[d] += 1
    assert order == sorted(order)
    loose = mixing.mixed_documents(docs, [5, 2, 1], in_order=False)
    assert Counter(r.doc_id for r in loose.collect()) == Counter(got)


def test_mixed_rows(spark):
    docs = hard_docs(spark)
    out = mixing.mixed_documents(docs, [5, 2, 1], block=4)
    assert out.columns == docs.columns
    known = Counter(map(repr, docs.collect()))
    got = Counter(map(repr, out.collect()))
    assert 0 < sum(got.values()) and all(n <= 3 * known[r] for r, n in got.items())


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_spans(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m.group())] for k, (p, ok) in PLAIN.items()}


TRICKY = [
    "a@b.c_x@d.e foo@bar.com.", "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1", "+1 (524) 555-7373 + 1 +12 3456789 9",
    "4111 1111 1111 1111 5  4111-1111-1111-1111", "a@b@c.d.e-", "é ü 4111111111111111 é", "1" * 3000,
    "x@y.z" * 200, "12 34 " * 500, "+1+2+3 +123456789", "1..2.3.4.5", "4111  1111", "..@a.b..c",
]


def test_spans_match_plain_patterns(spark):
    cases = [(i, t) for i, t in enumerate(TRICKY)] + [(1000 + i, r[1]) for i, r in enumerate(hard_rows())]
    cases += [(10_000 + i, t) for i, t in rows_of(sf_docs(spark))]
    got = pii.find_spans(spark.createDataFrame(cases, "doc_id long, text string")).collect()
    texts = dict(cases)
    for r in got:
        for kind, spans in plain_spans(texts[r.doc_id]).items():
            assert [(s.start, s.end) for s in r[kind]] == spans, (kind, texts[r.doc_id][:80])


def test_checksums_and_context(spark):
    cases = [
        (0, "account DE89 3704 0044 0532 0130 00."), (1, "account DE88 3704 0044 0532 0130 00."),
        (2, "my social security number 123-45-6789"), (3, "part 123-45-6789"), (4, "ssn 000-45-6789")]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert len(got[0].iban) == 1 and not got[1].iban
    assert [len(got[i].ssn) for i in (2, 3, 4)] == [1, 0, 0]
    plain, near = pii.find_spans(spark.createDataFrame(
        [(0, "4111111111111111"), (1, "visa card 4111111111111111")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert near.card[0].score > plain.card[0].score


def test_very_many_spans_of_one_text(spark):
    parts = [f"ä{i % 7} a{i}@b{i % 9}.de" for i in range(20000)]
    text, at, expected = " ".join(parts), 0, []
    for part in parts:
        start = at + part.index(" ") + 1
        expected.append((start, at + len(part)))
        at += len(part) + 1
    got = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.start, x.end) for x in got.email] == expected


def test_running_sums(spark):
    values = [[], [5], [1, 2, 3], list(range(100))]
    got = spark.createDataFrame([(v,) for v in values], "v array<int>").select(pii.running_sums(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [[sum(v[: i + 1]) for i in range(len(v))] for v in values]


def test_empty_tables(spark):
    none = empty_docs(spark)
    assert sharding.shard_by_bytes(none, 4).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert mixing.mix_sources(none, [5, 2, 1]).count() == 0
    assert pii.find_spans(none).count() == 0


def test_main_paths_have_no_python(spark, tmp_path):
    for name in ("op1_sharding", "op2_exact_dedup", "op6_mixing", "op7_pii"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
