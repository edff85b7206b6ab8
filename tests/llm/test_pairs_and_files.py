"""Near duplicates, archives and the pipeline against plain Python."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import empty_docs, hard_docs, hard_rows, sf_docs, words
from pyspark.sql import functions as F

import corpus_pipeline
from tauframe.llm import near_dedup, warc
from tauframe.llm.storage import shared_folder


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def plain_components(rows, k, percent):
    """Row number -> (set size, smallest id reachable) by comparing all that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return [(len(sets[i]), min(ids[find(i)], default=None)) for i in range(len(rows))]


def check(df, k, percent):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected = Counter((i, n, c) for (i, _), (n, c) in zip(rows, plain_components(rows, k, percent)))
    got = near_dedup.near_duplicates(df, k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    return got


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_groups_of_documents(spark, k, percent):
    got = check(sf_docs(spark, "sf0.01"), k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hard_cases(spark):
    got = check(hard_docs(spark), 3, 85)
    groups = Counter(r.component_id for r in got if r.n_shingles and r.component_id is not None)
    kept = Counter(r.component_id for r in got if r.n_shingles and r.kept)
    assert all(kept[c] == 1 for c in groups)
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0
    left = near_dedup.drop_near_duplicates(hard_docs(spark), words_per_shingle=3, percent=85)
    assert left.columns == hard_docs(spark).columns and 0 < left.count() < len(hard_rows())


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_no_pair_at_the_threshold_is_lost(spark, k, percent):
    """Pairs as far apart as the threshold lets them be, over set sizes from 3 to 1,000."""
    rng = random.Random(percent)
    rows = []
    for size in (3, 5, 7, 10, 15, 20, 30, 40, 60, 80, 100, 130, 149, 151, 165, 176, 180, 188, 200, 300, 1000):
        for _ in range(40):
            base = [f"v{rng.randrange(10**6)}" for _ in range(size + k - 1)]
            # Other last words change as many shingles: size - m shared of size + m.
            m = int(size * (100 - percent) / (100 + percent))
            other = base[: len(base) - m] + [f"u{rng.randrange(10**6)}" for _ in range(m)]
            if size > 100 and rng.random() < 0.5:  # another size instead: size shared of size + more
                other = base + [f"u{rng.randrange(10**6)}" for _ in range(int(size * (100 / percent - 1)))]
            for words_ in (base, other):
                rows.append((len(rows), " ".join(words_)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    lost = [i for i in range(0, len(rows), 2) if got[i + 1] != i]
    assert lost == []


def test_many_members_that_are_not_linked(spark):
    """Texts that share most shingles but not enough stay apart, in any number."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = list(base)
        for at in rng.sample(range(200), 5):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, 3, 85)
    check(df, 5, 80)


def test_one_large_group_of_chained_copies(spark):
    """Copies drift from the first, so links must be found across many blocks."""
    rng = random.Random(4)
    text, rows = [f"w{rng.randrange(500)}" for _ in range(150)], []
    for i in range(420):
        if i % 3 == 0:
            text = list(text)
            text[rng.randrange(150)] = f"n{i}"
        other = list(text)
        other[rng.randrange(150)] = f"m{i}"
        rows.append((i, " ".join(other)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        b = a.copy()
        new = int(len(a) * (1 - share) / (1 + share))
        b[:new] = rng.integers(0, 2**64, new, dtype=np.uint64)
        sets = [np.sort(a), np.sort(b)]
        doc = np.repeat([0, 1], [len(a), len(b)])
        registers = near_dedup.registers_of(doc, np.concatenate(sets), 2)
        guess, _ = near_dedup.estimate(registers[:1], registers[1:])
        errors.append(abs(guess[0] - share))
    assert max(errors) < 0.15


PAGES = [
    (5, "http://a/5", "same"), (3, "http://a/3\nx", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""),
    (4, "u", "é" * 100_000), (None, "u", "same"), (7, "u", "own"), (7, "u", "own"), (8, "u", "\r\n\r\nWARC/1.1\r\n")]
PAGE_SCHEMA = "page_id long, url string, html string"


def plain_records(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        smallest = first.get(html or "")
        refers = smallest if smallest is not None and smallest != i else None
        out.append((i, len(body), digest, "response" if refers is None else "revisit", refers))
    return Counter(out)


@pytest.mark.parametrize("frame_bytes, bundle_bytes", [(1, 1), (400, 1000), (1 << 18, 1 << 24)])
def test_archives_round_trip(spark, frame_bytes, bundle_bytes):
    folder = warc.archive_folder(spark)
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    index = warc.write_bundles(pages, folder, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    got = warc.read_bundles(spark, folder, index).collect()
    assert Counter(map(tuple, got)) == plain_records(PAGES)
    bodies = defaultdict(set)
    for i, _, html in PAGES:
        bodies[i].add((html or "").encode())
    for r in index.collect():
        headers, block = warc.parse_record(warc.read_record(folder, r.bundle, r.frame, r.offset, r.length))
        assert headers["WARC-Type"] == "revisit" or block in bodies[r.page_id]
        assert r.length > 0


def test_archives_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(pages.repartition(3), folder)
    expected = plain_records([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert Counter(map(tuple, warc.read_bundles(spark, folder, index).collect())) == expected


def test_no_pages_no_bundles(spark):
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(spark.createDataFrame([], PAGE_SCHEMA), folder)
    assert index.count() == 0 and warc.read_bundles(spark, folder, index).count() == 0


def test_frames_decompress_alone(spark):
    import zstandard
    from pyarrow import fs

    folder = warc.archive_folder(spark)
    index = warc.write_bundles(spark.createDataFrame(PAGES, PAGE_SCHEMA), folder, frame_bytes=500)
    bundle = index.first().bundle
    system, path = fs.FileSystem.from_uri(f"{folder}/{bundle}")
    content = system.open_input_file(path).read()
    frames = warc.seek_table(lambda at, n: content[at : at + n], len(content))
    plain = b"".join(zstandard.ZstdDecompressor().decompress(content[a : a + n]) for a, n, _ in frames)
    # Readers that know nothing of the seek table skip it.
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole == plain


def test_pipeline_stages(spark):
    """Each stage's decisions, judged on its own input."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, seen = [], {}
    for name, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        names.append(name)
        seen[name] = (docs.toPandas(), after.toPandas())
        docs = after
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    columns = list(seen["quality"][0].columns)
    assert all(list(seen[n][1].columns) == columns for n in names[:-1])
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    good = before[before.doc_id.map(labels) == 1].doc_id
    assert 0 < len(after) < len(before) and good.isin(after.doc_id).mean() > 0.95
    before, after = seen["exact_dedup"]
    assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.max())
    before, after = seen["near_dedup"]
    groups = plain_components(list(zip(before.doc_id, before.text)), 5, 80)
    assert sorted(after.doc_id) == sorted({c for _, c in groups})
    before, after = seen["mixing"]
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 3
    before, after = seen["sentencepiece"]
    assert len(after) == len(before) and after.lossless.all()


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_tile_rows_grow_with_a_family(spark):
    """Documents that share a bucket and are not linked are sent to a bounded number of tiles."""
    none = spark.range(0).selectExpr("id as node", "id as root")
    sent = []
    for n in (4_000, 16_000):
        buckets = spark.range(n).selectExpr("7L as band_key", "id as key")
        led = spark.range(n).selectExpr("id as key", "0L as leader")
        blocks = near_dedup._component_blocks(led, none)
        sizes = {r.blk: r.n for r in blocks.groupBy("blk").agg(F.count("key").alias("n")).collect()}
        tiles = near_dedup._open_tiles(buckets, blocks, none).collect()
        assert len(tiles) == len(sizes) * (len(sizes) + 1) // 2
        sent.append(sum(sum(sizes[b] for b in {t.i, t.j}) for t in tiles))
    assert sent[1] <= 5 * sent[0]


def test_clusters_join_their_leaders_family(spark):
    led = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (9, 9), (10, 9)], "key long, leader long")
    assert sorted(map(tuple, near_dedup._families(led).collect())) == [
        (0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (9, 9), (10, 9)]
