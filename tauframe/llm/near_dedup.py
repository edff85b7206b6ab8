"""Near duplicates by HyperMinHash registers, banding and verification on full sets.

Signature. A document's distinct shingles are hashed to 64 bits. The first bits choose
one of ``REGISTERS`` buckets; of the smallest remainder in a bucket, the register keeps the
number of leading zeros and ten mantissa bits, 16 bits in all.

Short sets fill few buckets, so sets of up to ``SHORT / threshold`` shingles get their band
registers from as many hash functions, one register each; sets above ``SHORT`` use the
buckets. Both kinds exist where they meet, so every similar pair shares one kind.

Candidates. A band is a fixed random choice of ``rows`` registers, empty ones filled from the
next non-empty one; documents that agree on a band fall in one bucket. Documents with
equal sets are one class with one representative, so groups of copies never enter the
buckets. Documents are dealt to blocks of about ``BLOCK``, cluster by cluster (a cluster is what
has the same first member in its largest bucket), and two blocks are compared as a tile,
all documents of one with all of the other: pairs are never rows. First each block meets the
block of its cluster's first member; links found true join documents to components. Then
clusters are joined to families (a first member leads to the first of its own largest bucket,
and so on), documents are dealt anew by family and component, and blocks that meet in a bucket
are compared unless one component holds both. In this round blocks grow with their family,
``LOTS`` to each of its components, up to ``WIDEST`` documents: a document is sent to a bounded
number of tiles of its family up to ``LOTS * WIDEST`` documents. What grows with the square of
a family is the comparing in the task, of documents that the first round left out of its
largest component. No candidate is left out.

Decision. A pair's Jaccard similarity is estimated from its registers, corrected for
chance collisions; pairs more than ``DEVIATIONS`` standard deviations below the threshold
are dropped, all others are decided on the full sets. Components come from alternating
large-star and small-star steps.

At the threshold a pair shares no band with a probability near 3e-8 (80 bands of 10 at
0.85) or 3e-10 (120 bands of 8 at 0.8) for independent registers; ``band_plan`` chooses them
by the threshold. The registers of one document are not quite independent; the tests
measure the loss over set sizes from 3 to 1,000 against brute force.

Choices: a null text or one without words has an empty set and stays alone. A text of fewer
words than a shingle is one shingle. Null ids come last when the row that stays is
chosen; repeated rows are one class, of which one row stays. An empty table gives no rows.
Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauframe.llm.storage import as_scan, bound_batches, checkpoint, delete_folder, free_name, lean, release, shared_folder, with_locator
from tauframe.llm.textvec import U64, mix, shingle_sets, text_slices, words_of

REGISTERS = 256
BUCKET_BITS = 8
MANTISSA_BITS = 10
DEVIATIONS = 5.0
#: Two different minima share their leading zeros with probability 1/3, then the mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA_BITS)
#: Sets of up to this many shingles rest on hash functions instead of buckets.
SHORT = 150
BLOCK = 128
#: Blocks of a component of a family, and the most documents in one of them.
LOTS = 8
WIDEST = 4096
#: Pairs compared at once, and shingles of either side whose sets are decided in one row.
PAIRS = 1 << 20
SIDE_SHINGLES = 1 << 19

SIGNATURE = "at struct<file:string,row:long>, doc_id long, n long, fp1 long, fp2 long, registers binary, bands array<long>"


def band_plan(percent: int) -> tuple[int, int]:
    """(bands, rows): fewer rows and more bands for lower thresholds, a miss below 1e-7."""
    for rows, bands in ((10, 80), (8, 120), (6, 150), (4, 200)):
        if (1 - (percent / 100) ** rows) ** bands < 1e-7:
            return bands, rows
    return 250, 2


def band_choice(bands: int, rows: int) -> np.ndarray:
    """The registers of each band, the same in every run."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(REGISTERS)[:rows] for _ in range(bands)])


def registers_of(doc: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) registers of sorted sets; 0 marks an empty bucket."""
    cell = doc * REGISTERS + (shingle >> U64(64 - BUCKET_BITS)).astype(np.int64)
    # Sets are sorted, so the first shingle of a bucket is its smallest.
    first = np.ones(len(cell), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = np.maximum(shingle[first] & U64((1 << (64 - BUCKET_BITS)) - 1), U64(1)).astype(np.float64)
    # The exponent of a float counts leading zeros; its next bits are the mantissa.
    packed = (rest.view(np.uint64) >> U64(52 - MANTISSA_BITS)) - U64(1022 << MANTISSA_BITS)
    registers = np.zeros(n * REGISTERS, dtype=np.uint16)
    registers[cell[first]] = packed.astype(np.uint16)
    return registers.reshape(n, REGISTERS)


def _keys_of(values: np.ndarray, kind: int) -> np.ndarray:
    """(documents, bands) keys of (documents, bands, rows) register values."""
    keys = np.zeros(values.shape[:2], dtype=U64)
    for column in range(values.shape[2]):
        keys = keys * U64(0x9E3779B97F4A7C15) + values[:, :, column].astype(U64) + U64(1)
    band = np.arange(values.shape[1], dtype=np.uint64) + U64(1 + (kind << 20))
    return mix(keys ^ mix(band)[None, :])


def band_keys(registers: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """(documents, bands) keys; empty registers take the next non-empty one's value."""
    twice = np.concatenate((registers, registers), axis=1)
    place = np.where(twice > 0, np.arange(2 * REGISTERS), 2 * REGISTERS - 1)
    following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
    filled = np.take_along_axis(twice, following, axis=1)
    return _keys_of(filled[:, choice], 0)


def short_band_keys(shingle: np.ndarray, edges: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys from one register of each of ``bands * rows`` hash functions.

    ``edges`` delimits the documents' shingles; none is empty.
    """
    salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) ^ U64(0x2545F4914F6CDD1D)) | U64(1)
    values = np.empty((len(edges) - 1, bands * rows), dtype=np.uint16)
    if not len(values):
        return np.zeros((0, bands), dtype=U64)
    for k, odd in enumerate(salt):
        turned = shingle ^ (shingle >> U64(32))
        turned = turned * odd
        turned ^= turned >> U64(29)
        turned *= U64(0x9E3779B97F4A7C15)
        least = np.maximum(np.minimum.reduceat(turned, edges[:-1]) >> U64(11), U64(1)).astype(np.float64)
        values[:, k] = ((least.view(np.uint64) >> U64(52 - MANTISSA_BITS)) - U64(1022 << MANTISSA_BITS)).astype(np.uint16)
    return _keys_of(values.reshape(len(values), bands, rows), 1)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, buckets it rests on) of rows of registers."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    share = same / np.maximum(used, 1)
    return np.maximum(0.0, (share - COLLISION) / (1 - COLLISION)), used


def signatures(docs: DataFrame, words_per_shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    bands, rows = band_plan(percent)
    choice = band_choice(bands, rows)
    widest = SHORT * 100 // percent
    located = with_locator(docs.select(id_col, text_col), "at").select(
        "at", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                part, n = batch.slice(first, len(texts)), len(texts)
                doc, shingle = shingle_sets(words_of(texts, lower=True), words_per_shingle)
                size = np.bincount(doc, minlength=n)
                edges = np.concatenate(([0], np.cumsum(size)))
                total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(shingle))))
                other = np.concatenate((np.zeros(1, U64), np.cumsum(mix(shingle ^ U64(0x5851F42D4C957F2D)))))
                registers = registers_of(doc, shingle, n)
                far, near = np.flatnonzero(size > SHORT), np.flatnonzero((size > 0) & (size <= widest))
                short = (size[doc] > 0) & (size[doc] <= widest)
                cuts = np.concatenate(([0], np.cumsum(size[near])))
                keys = np.concatenate((
                    band_keys(registers[far], choice).ravel(), short_band_keys(shingle[short], cuts, bands, rows).ravel()))
                order = np.argsort(np.repeat(np.concatenate((far, near)), bands), kind="stable")
                held = bands * ((size > SHORT).astype(np.int64) + ((size > 0) & (size <= widest)))
                yield pa.RecordBatch.from_pydict({
                    "at": part.column("at"), "doc_id": part.column("doc_id"), "n": pa.array(size, pa.int64()),
                    "fp1": pa.array((total[edges[1:]] - total[edges[:-1]]).view(np.int64)),
                    "fp2": pa.array((other[edges[1:]] - other[edges[:-1]]).view(np.int64)),
                    "registers": pa.array([r.tobytes() for r in registers], pa.binary()),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32()),
                        pa.array(keys[order].view(np.int64))),
                })

    return located.mapInArrow(lean(sign), SIGNATURE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node it can reach.

    Large-star and small-star steps in turn; every step aggregates a minimum for each
    node, so a node with very many neighbours is no large group.
    """
    pairs = checkpoint(edges.select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u != v").distinct())
    # Equal sets of pairs have equal stamps; comparing these needs no shuffle.
    stamp = lambda p: tuple(p.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())
    before = stamp(pairs)
    while True:
        both = pairs.select("v", "u").unionAll(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        # Large star: larger neighbours of v move to the smallest neighbour of v.
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = checkpoint(large.filter("v != u").distinct())
        # Small star: v and its smaller neighbours move to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = checkpoint(small.unionAll(least.select("v", F.col("m").alias("u"))).filter("v != u").distinct())
        pairs, after = small, stamp(small)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return checkpoint(roots.unionAll(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()))


def _leaders(buckets: DataFrame) -> DataFrame:
    """(key, leader): the first member of each document's largest bucket."""
    return checkpoint(buckets.groupBy("key").agg(F.max(F.struct("_n", -F.col("_first"))).alias("x")).select(
        "key", (-F.col("x.col2")).alias("leader")))


def _families(led: DataFrame) -> DataFrame:
    """(key, leader) with each leader replaced by the last that its own leaders lead to.

    A leader is the first member of its cluster's bucket, so the ids fall on the way, and it
    has a leader of its own. Ways double with every step, and only leaders are rows of it.
    """
    ways = checkpoint(led.select("leader").distinct().join(led.toDF("leader", "up"), "leader"))
    while True:
        ways = checkpoint(ways.join(ways.toDF("up", "_up"), "up").select(
            "leader", F.col("_up").alias("up"), (F.col("up") != F.col("_up")).alias("moved")))
        if ways.filter("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return checkpoint(led.join(ways, "leader").select("key", F.col("up").alias("leader")))


def _dealt(rows: DataFrame, by: list[str], most: int = BLOCK) -> DataFrame:
    """(key, blk): rows dealt to blocks that hold one value of ``by``.

    A block has about ``BLOCK`` rows, or an equal share of ``LOTS`` if that is more, up to ``most``.
    """
    n = F.count(F.lit(1))
    wide = F.greatest(F.lit(BLOCK), F.least(F.ceil(n / LOTS), F.lit(most)))
    sizes = rows.groupBy(*by).agg(F.ceil(n / wide).alias("_lots"))
    return checkpoint(rows.join(sizes, by).select(
        "key", F.xxhash64(*by, F.pmod(F.xxhash64("key"), F.col("_lots"))).alias("blk")))


def _component_blocks(led: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks by family and component; components of less than a block share theirs.

    Two blocks of one large component never meet, whatever its size: only documents
    outside it are compared with its members.
    """
    rooted = led.join(labels.toDF("key", "_root"), "key", "left").withColumn("root", F.coalesce("_root", "key"))
    large = rooted.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= BLOCK)
    part = F.coalesce(F.when(F.col("_c").isNotNull(), F.col("root")), F.lit(-1).cast("long"))
    parts = rooted.join(large, ["leader", "root"], "left").select("key", "leader", part.alias("part"))
    return _dealt(parts, ["leader", "part"], WIDEST)


def _tiles(pairs: DataFrame) -> DataFrame:
    """Distinct unordered pairs of blocks (i, j) as rows (i, j, tile)."""
    return pairs.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct().withColumn(
        "tile", F.xxhash64("i", "j"))


def _pairs(out: dict) -> pa.RecordBatch:
    kinds = {"tile": pa.int64(), "a": pa.list_(pa.int64()), "b": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({name: pa.array(out[name], kind) for name, kind in kinds.items()})


def _likely(tiles: DataFrame, blocks: DataFrame, signed: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(tile, a, b): pairs of each tile whose estimate does not rule the threshold out.

    A tile compares all documents of its two blocks that are not in one component yet. Its
    pairs come in several rows, each a tile of its own, if the sets of a side are large.
    """
    roots = blocks.join(labels.toDF("key", "_root"), "key", "left").select(
        "key", "blk", F.coalesce("_root", "key").alias("root"))
    held = roots.join(signed.select("key", "n", "registers"), "key")
    sides = tiles.select("tile", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    groups = sides.join(held, "blk").groupBy("tile", "i", "j").agg(
        F.collect_list(F.struct("blk", "key", "root", "n", "registers")).alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = {"tile": [], "a": [], "b": []}, 0
            for tile, i, j, cell in zip(*(batch.column(c).to_pylist() for c in ("tile", "i", "j")), batch.column("members"), strict=True):
                blk, key, root, n = (np.asarray(cell.values.field(c)) for c in ("blk", "key", "root", "n"))
                regs = np.frombuffer(b"".join(cell.values.field("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
                run = np.zeros(len(key), np.int64)
                for side in (left, right):
                    run[side] = np.cumsum(n[side]) // SIDE_SHINGLES
                step = max(1, PAIRS // max(1, len(right)))
                for low in range(0, len(left), step):
                    some = left[low : low + step]
                    cross = root[some][:, None] != root[right][None, :]
                    if i == j:
                        cross &= some[:, None] < right[None, :]
                    x, y = np.nonzero(cross)
                    a, b, keep = some[x], right[y], [np.zeros(0, bool)]
                    for at in range(0, len(a), 8192):
                        guess, used = estimate(regs[a[at : at + 8192]], regs[b[at : at + 8192]])
                        keep.append(guess >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(used, 1)))
                    keep = np.concatenate(keep)
                    a, b = a[keep], b[keep]
                    sides = run[a] * (run[right[-1]] + 1) + run[b]
                    for part in np.unique(sides):
                        one = sides == part
                        name = mix(np.array([tile, low, part], np.int64).view(U64))
                        out["tile"].append(int(mix(name[:1] ^ (name[1:2] * U64(3)) ^ (name[2:] * U64(5))).view(np.int64)[0]))
                        out["a"].append(key[a[one]])
                        out["b"].append(key[b[one]])
                    held += len(a)
                    if held >= PAIRS:
                        yield _pairs(out)
                        out, held = {"tile": [], "a": [], "b": []}, 0
            yield _pairs(out)

    return checkpoint(groups.select("tile", "i", "j", "members").mapInArrow(
        lean(compare), "tile long, a array<long>, b array<long>"))


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, through the places of shared members."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    used_a, row_a = np.unique(a, return_inverse=True)
    used_b, row_b = np.unique(b, return_inverse=True)
    size = np.zeros((len(used_a), len(used_b)), dtype=np.float32)
    width = min(1 << 14, max(64, (1 << 20) // max(1, len(sets))))
    for low in range(0, int(place.max()) + 1 if len(place) else 0, width):
        inside = (place >= low) & (place < low + width)
        table = np.zeros((len(sets), width), dtype=np.float32)
        table[owner[inside], place[inside] - low] = 1
        size += table[used_a] @ table[used_b].T
    return size[row_a, row_b].astype(np.int64)


def smallest_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one that the links (x, y) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _true_links(likely: DataFrame, signed: DataFrame, docs: DataFrame, words_per_shingle: int, percent: int, text_col: str) -> DataFrame:
    """Edges (a, b) that connect what pairs with 100 * intersection >= percent * union connect.

    Every likely pair is decided on its full sets. Of a tile's true links, each document
    keeps an edge to the first one it reaches, so a dense tile yields few rows.
    """
    members = checkpoint(likely.select("tile", F.explode(F.array_union("a", "b")).alias("key")))
    needed = checkpoint(members.select("key").distinct().join(signed.select("key", "at"), "key"))
    texts = with_locator(docs.select(text_col), "at").join(needed, "at").select("key", F.col(text_col).alias("text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column("text")):
                doc, shingle = shingle_sets(words_of(part, lower=True), words_per_shingle)
                edge = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column("key").slice(first, len(part)),
                    "members": pa.array([shingle[edge[i] : edge[i + 1]].tobytes() for i in range(len(part))], pa.binary())})

    sets = texts.mapInArrow(lean(collect), "key long, members binary")
    groups = members.join(sets, "key").groupBy("tile").agg(F.collect_list(F.struct("key", "members")).alias("sets"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [np.zeros((0, 2), np.int64)]
            for a, b, cell in zip(batch.column("a"), batch.column("b"), batch.column("sets"), strict=True):
                key = np.asarray(cell.values.field("key"))
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.values.field("members")]
                order = np.argsort(key)
                x, y = (order[np.searchsorted(key[order], np.asarray(c.values))] for c in (a, b))
                size = np.array([len(s) for s in sets])
                both = common(sets, x, y)
                keep = 100 * both >= percent * (size[x] + size[y] - both)
                first = smallest_reached(len(key), x[keep], y[keep])
                moved = np.flatnonzero(first != np.arange(len(key)))
                links.append(np.stack((key[moved], key[first[moved]]), 1))
            found = np.concatenate(links)
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return checkpoint(likely.join(groups, "tile").select("a", "b", "sets").mapInArrow(lean(confirm), "a long, b long"))


def _open_tiles(buckets: DataFrame, blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles of blocks that meet in a bucket and hold several components."""
    roots = blocks.join(labels.toDF("key", "_root"), "key", "left").select(
        "key", "blk", F.coalesce("_root", "key").alias("root"))
    spans = checkpoint(buckets.join(roots, "key").groupBy("band_key", "blk").agg(
        F.min("root").alias("low"), F.max("root").alias("high")))
    mixed = spans.groupBy("band_key").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).filter("_low < _high")
    open_ = checkpoint(spans.join(mixed.select("band_key"), "band_key"))
    other = open_.toDF("band_key", "y", "_l", "_h")
    met = open_.withColumnRenamed("blk", "x").join(other, "band_key").filter(
        (F.col("x") <= F.col("y")) & (F.least("low", "_l") < F.greatest("high", "_h")))
    return _tiles(met.select("x", "y"))


def near_duplicates(
    docs: DataFrame,
    words_per_shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: at, doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links reach, ``kept`` marks its row.
    """
    spark = docs.sparkSession
    # Texts are found again by their place, so all steps must scan the same files.
    docs = as_scan(docs.select(id_col, text_col))
    folder = shared_folder(spark, "signatures")
    signatures(docs, words_per_shingle, percent, id_col, text_col).withColumn(
        "key", F.monotonically_increasing_id()).write.parquet(folder)
    signed = spark.read.parquet(folder)

    sets = signed.filter("n > 0").groupBy("n", "fp1", "fp2").agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("_copies"))
    copies = checkpoint(sets.filter("_copies > 1").drop("_copies"))
    classes = checkpoint(signed.select("key", "doc_id", "at", "n", "fp1", "fp2").join(
        copies, ["n", "fp1", "fp2"], "left").select("key", "doc_id", "at", "n", F.coalesce("rep", "key").alias("rep")))

    repeats = classes.filter("key != rep").select("key")
    banded = signed.filter("n > 0").select("key", "bands").join(repeats, "key", "left_anti").select(
        "key", F.explode("bands").alias("band_key"))
    counted = banded.groupBy("band_key").agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    buckets = checkpoint(banded.join(counted, "band_key").select("band_key", "key", "_first", "_n"))
    release(spark)

    led = _leaders(buckets)
    blocks = _dealt(led, ["leader"])

    def links_of(tiles: DataFrame, blocks: DataFrame, labels: DataFrame) -> DataFrame:
        likely = _likely(tiles, blocks, signed, labels, percent / 100)
        found = _true_links(likely, signed, docs, words_per_shingle, percent, text_col)
        release(spark)
        return found

    star = led.filter("key != leader").join(blocks.toDF("key", "x"), "key").join(blocks.toDF("leader", "y"), "leader")
    none = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))
    links = links_of(checkpoint(_tiles(star.select("x", "y"))), blocks, none)
    labels = components(links)
    release(spark)
    blocks = _component_blocks(_families(led), labels)
    cross = links_of(checkpoint(_open_tiles(buckets, blocks, labels)), blocks, labels)
    if not cross.isEmpty():
        labels = components(links.unionAll(cross))

    rooted = checkpoint(classes.join(labels.toDF("rep", "_root"), "rep", "left").withColumn(
        "root", F.coalesce("_root", "rep")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("key").alias("k"))).alias("_best")
    heads = rooted.groupBy("root").agg(best, F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "root", F.col("_best.id").alias("_id"), F.col("_best.k").alias("_k"))
    alone = F.col("_k").isNull()
    result = checkpoint(rooted.join(heads, "root", "left").select(
        "at", "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("_id")).alias("component_id"),
        (alone | (F.col("_k") == F.col("key"))).alias("kept")))
    delete_folder(spark, folder)
    return result


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates."""
    at = free_name(docs, "_at")
    located = with_locator(docs, at)
    stays = near_duplicates(located.drop(at), **options).filter("kept").select(F.col("at").alias(at))
    return located.join(stays, at, "left_semi").select(docs.columns)
