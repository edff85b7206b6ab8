"""Language-model scores from a probabilistic suffix tree over words.

Symbols are lower-cased words and one end for each text. The root is the add-one unigram
distribution. Every context of up to ``depth`` words with ``MIN_COUNT`` occurrences is a
candidate, whatever the size of the corpus, and every next symbol with ``MIN_COUNT``
occurrences after it is kept, the others pooled. A candidate becomes a state if its next
symbols diverge from those of its longest suffix state: a likelihood-ratio test, and a
divergence of ``MIN_NATS``. Kept next symbols are smoothed with ``SMOOTHING`` pseudo-counts
spread like the suffix state's distribution; the rest of the mass is spread like it, too, so
every state's distribution sums to one. A text's score is the sum of log10 probabilities,
each token's by the longest suffix state of the words before it in the text.

Counts cover every training token. Counting is pre-aggregated in the task, then summed by
hash. Most runs of symbols are too rare to be kept, so a first pass counts cells of their
hashes, which travel as compressed differences; only runs in a cell with ``MIN_COUNT``
occurrences, among them all that have as many themselves, travel as arrays to be counted
exactly, in lots by their hash. Contexts are tested by group.
States and their next symbols are tables that grow with the corpus. What each adds to a
token's log10 probability does not depend on the others: a state the factor of what it
leaves over, a next symbol the rest. So lookups are summed by text in any order. The most
frequent ``head_rows`` of each are broadcast for lookups in the task, as are the counts of
frequent words (at most 1 / head_share of them); all others meet what is looked up lot by lot,
a lot being a range of keys, which travel as compressed differences. A bitmap of fixed size
spares tokens that cannot meet a row there; it decides nothing.

Choices: words are identified by a 64-bit hash. A null text is empty and has the end only;
a null id counts as empty text in the split. Repeated rows count each. Without training
rows every probability is that of an unseen word. An empty table gives no rows. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauframe.llm.storage import bound_batches, checkpoint, lean, release, with_locator
from tauframe.llm.textvec import U64, mix, text_slices, windows, words_of

END = U64(0x0E0F0E0F0E0F0E0F)
MIN_COUNT = 8
MIN_NATS = 1e-3
SMOOTHING = 8.0
#: Standard deviations of the test statistic beyond its mean.
TEST_WIDTH = 4.0
#: A bitmap has 2 ** CELL_BITS cells, one for each value of a key's first bits.
CELL_BITS = 26
#: The bitmap of cells to count exactly grows to 2 ** MOST_CELL_BITS, a quarter of the tokens.
MOST_CELL_BITS = 28
#: Runs of symbols and keys that a task holds before it sends them, and lots in a shuffle partition.
HELD_GRAMS = 1 << 20
HELD_KEYS = 1 << 22
LOTS = 2
#: A text has a sum for each lot its lookups fall into, so few lots would make sums grow with the partitions.
LEAST_SCORE_LOTS = 128


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, tokens of each text): all words, then one end, of every text."""
    words = words_of(texts, lower=True)
    count = words.count + 1
    ends = np.cumsum(count) - 1
    symbol = np.empty(int(count.sum()), dtype=U64)
    symbol[np.arange(len(words.doc)) + words.doc] = words.hashes()
    symbol[ends] = END
    return symbol, np.repeat(np.arange(len(count)), count), count


def contexts(symbol: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the next symbol, hash of the ``length`` symbols before it)."""
    at, key = windows(symbol, doc, length)
    inside = at + length < len(symbol)
    at, key = at[inside], key[inside]
    same = doc[at + length] == doc[at]
    return at[same] + length, key[same]


def context_key(symbols: tuple[int, ...]) -> int:
    array = np.array(symbols, dtype=U64)
    return int(windows(array, np.zeros(len(array), np.int64), len(array))[1][0])


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the keys with each value of the first bits start; keys are hashes, so few share one."""
    bits = max(1, len(sorted_keys).bit_length())
    sizes = np.bincount((sorted_keys >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.concatenate(([0], np.cumsum(sizes)))


def find(sorted_keys: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each wanted key; ``starts`` comes from ``starts_of``."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    cell = (wanted >> U64(64 - len(sorted_keys).bit_length())).astype(np.int64)
    place, last, found = starts[cell], starts[cell + 1], np.zeros(len(wanted), bool)
    open_ = np.flatnonzero(place < last)
    while len(open_):
        hit = sorted_keys[place[open_]] == wanted[open_]
        found[open_[hit]] = True
        open_ = open_[~hit]
        place[open_] += 1
        open_ = open_[place[open_] < last[open_]]
    return np.minimum(place, len(sorted_keys) - 1), found


def cells(keys: DataFrame, name: str = "key") -> np.ndarray:
    """The bitmap of the keys in column ``name``; at most 2 ** (CELL_BITS - 6) rows reach the driver."""
    shift = 64 - CELL_BITS
    words = keys.select(F.col(name).alias("k")).groupBy(F.expr(f"shiftrightunsigned(k, {shift + 6})").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(k, {shift}) & 63 as int)))").alias("bits")).toArrow()
    found = np.zeros(1 << (CELL_BITS - 6), dtype=U64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return found


def in_cells(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the cell of each key is set; the bitmap's length, a power of two, says how many there are."""
    if not len(bitmap):
        return np.zeros(len(key), bool)
    cell = key >> U64(64 - 6 - (len(bitmap).bit_length() - 1))
    return (bitmap[(cell >> U64(6)).astype(np.int64)] >> (cell & U64(63))) & U64(1) > 0


def row_keys(rows: np.ndarray) -> np.ndarray:
    """The context key of the symbols in each row."""
    n, k = rows.shape
    return windows(np.ascontiguousarray(rows).ravel(), np.repeat(np.arange(n), k), k)[1]


def entry_keys(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    # Not symbol + 1, which is symbol ^ 1 for an even one: a pair and its reverse would meet.
    return mix(context ^ mix(symbol + U64(0x5851F42D4C957F2D)))


@dataclass
class Level:
    """States with contexts of one length, and the entries of their next symbols.

    A state adds ``log_rest`` to the log10 probability by its suffix state, an entry ``gain`` to that.
    """

    context: np.ndarray
    log_rest: np.ndarray
    entry: np.ndarray
    gain: np.ndarray

    def __post_init__(self) -> None:
        self.context_at, self.entry_at = starts_of(self.context), starts_of(self.entry)


@dataclass
class SuffixTree:
    """The broadcast part of the model; ``total`` tokens, ``distinct`` symbols.

    ``tail`` has the other states and entries as rows (key, value), ``tail_cells`` their bitmap.
    """

    total: int
    distinct: int
    head: np.ndarray
    head_log: np.ndarray
    levels: list[Level] = field(default_factory=list)
    tail_cells: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    tail: DataFrame | None = None

    def __post_init__(self) -> None:
        self.head_at = starts_of(self.head)

    def parts(self) -> tuple:
        """The model as plain arrays, which any Python worker can read."""
        return (self.total, self.distinct, self.head, self.head_log, [
            (x.context, x.log_rest, x.entry, x.gain) for x in self.levels], self.tail_cells)

    @classmethod
    def of_parts(cls, parts: tuple) -> SuffixTree:
        return cls(*parts[:4], [Level(*x) for x in parts[4]], parts[5])

    @property
    def log_all(self) -> float:
        return float(np.log10(self.total + self.distinct + 1))


def _map_texts(rows: DataFrame, work, schema: str, keep: list[str], setup: Callable[[], tuple] = tuple) -> DataFrame:
    """Apply ``work(part, texts, *setup())`` to bounded slices; it returns Arrow arrays by name."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = setup()
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict(work(batch.slice(first, len(texts)), texts, *own))

    return rows.select(*keep, "text").mapInArrow(lean(run), schema)


def symbol_counts(train: DataFrame) -> DataFrame:
    """(symbol, n): exact counts of all symbols of the ``text`` column."""

    def count(part, texts) -> dict:
        symbol, n = np.unique(tokens(texts)[0], return_counts=True)
        return {"symbol": pa.array(symbol.view(np.int64)), "n": pa.array(n, pa.int64())}

    return _map_texts(train, count, "symbol long, n long", []).groupBy("symbol").agg(F.sum("n").alias("n"))


def _candidates(symbol: np.ndarray, doc: np.ndarray, length: int, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, key) of runs of ``length`` + 1 symbols; both runs inside have a cell in ``shorter``."""
    at, key = windows(symbol, doc, length)
    good = np.zeros(len(symbol) + 1, bool)
    good[at[in_cells(shorter, key)]] = True
    first, key = windows(symbol, doc, length + 1)
    fit_ = good[first] & good[first + 1]
    return first[fit_], key[fit_]


def gram_cells(train: DataFrame, length: int, shorter: np.ndarray, total: int) -> np.ndarray:
    """A bitmap of the runs of ``length`` + 1 symbols that may have ``MIN_COUNT`` occurrences, and all that do.

    Runs are counted by cells of their keys, of which there are 8 to 16 for each of the ``total``
    tokens. Counts are summed up to ``MIN_COUNT`` in the task, which keeps what reaches it.
    ``shorter`` is as in ``gram_counts``. At most 2 ** (MOST_CELL_BITS - 6) rows for the bitmap's
    words, and two for each lot, reach the driver.
    """
    spark = train.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(shorter)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = LOTS * parts
    fine = U64(64 - max(CELL_BITS, total.bit_length() + 3))
    word = U64(64 + 6 - min(MOST_CELL_BITS, max(CELL_BITS, total.bit_length() - 2)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                symbol, doc, _ = tokens(texts)
                held.append(_candidates(symbol, doc, length, shared.value)[1] >> fine)
                size += len(held[-1])
                if size >= HELD_KEYS:
                    yield _packed_cells(np.concatenate(held), fine, lots)
                    held, size = [], 0
        if size:
            yield _packed_cells(np.concatenate(held), fine, lots)

    def total_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for lot, size, planes in zip(*(batch.column(c).to_pylist() for c in ("lot", "size", "planes")), strict=True):
                if held and lot != now:
                    yield _frequent_words(held, fine, word)
                    held = []
                now = lot
                held.append(_of_planes(size, planes))
        if held:
            yield _frequent_words(held, fine, word)

    packed = train.select("text").mapInArrow(lean(count), "lot long, size long, planes array<binary>")
    words = packed.repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(
        lean(total_), "word long, bits long").toArrow()
    found = np.zeros(1 << (64 - int(word)), dtype=U64)
    # Two lots can share a word at their edge.
    np.bitwise_or.at(found, words["word"].to_numpy(), words["bits"].to_numpy().view(U64))
    return found


def _lot_edges(key: np.ndarray, lots: int) -> tuple[np.ndarray, np.ndarray]:
    """(lots, where each begins and the last ends) of sorted keys; a lot is a range of keys."""
    lot = (((key >> U64(44)) * U64(lots)) >> U64(20)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(lot, prepend=-1)), len(lot))
    return lot[edges[:-1]], edges


def _planes(rising: np.ndarray, other: np.ndarray) -> list[bytes]:
    """The differences of ``rising`` and the values of ``other``, compressed.

    Bytes of one place stand together: the low ones are near random, the high ones near zero.
    """
    columns = (np.diff(rising, prepend=U64(0)), np.ascontiguousarray(other, U64))
    return [pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True) for c in columns for x in c.view(np.uint8).reshape(-1, 8).T]


def _of_planes(size: int, planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.stack([np.frombuffer(pa.decompress(x, size, "zstd"), np.uint8) for x in planes], 1).view(U64)
    return np.cumsum(raw[:, 0], dtype=U64), raw[:, 1]


def _packed_cells(cell: np.ndarray, fine: U64, lots: int) -> pa.RecordBatch:
    """A row (lot, size, planes) for each lot of cells, with their counts up to ``MIN_COUNT``."""
    cell, n = np.unique(cell, return_counts=True)
    lot, edges = _lot_edges(cell << fine, lots)
    n = np.minimum(n, MIN_COUNT)
    return pa.RecordBatch.from_pydict({
        "lot": pa.array(lot), "size": pa.array(np.diff(edges)),
        "planes": pa.array([_planes(cell[a:b], n[a:b]) for a, b in zip(edges, edges[1:])], pa.list_(pa.binary()))})


def _frequent_words(held: list[tuple[np.ndarray, np.ndarray]], fine: U64, word: U64) -> pa.RecordBatch:
    """(word, bits) of the bitmap, for the cells of one lot whose counts sum to ``MIN_COUNT``."""
    cell, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(cell)
    cell = cell[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), cell[1:] != cell[:-1])))
    key = cell[first[np.add.reduceat(n[order], first) >= U64(MIN_COUNT)]] << fine
    bits = U64(1) << ((key >> (word - U64(6))) & U64(63))
    at = (key >> word).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
    return pa.RecordBatch.from_pydict({"word": pa.array(at[first]), "bits": pa.array(bits.view(np.int64))})


def gram_counts(
    train: DataFrame, length: int, shorter: np.ndarray, head: np.ndarray, wanted: np.ndarray | None = None,
) -> DataFrame:
    """(w0, ..., w<length>, n): a context and its next symbol, with ``MIN_COUNT`` occurrences.

    ``shorter`` is the bitmap of the runs of ``length`` symbols that have as many: a run of
    one more can have them only if both runs inside it have. ``head`` are sorted symbols, whose
    places stand for them on the way. ``wanted``, from ``gram_cells``, spares runs that are rare.
    """
    spark = train.sparkSession
    bound_batches(spark)
    shared, known = spark.sparkContext.broadcast((shorter, wanted)), spark.sparkContext.broadcast(head)
    names = [f"w{j}" for j in range(length + 1)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = LOTS * parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, starts = [], 0, starts_of(known.value)
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                symbol, doc, _ = tokens(texts)
                shorter, wanted = shared.value
                first, key = _candidates(symbol, doc, length, shorter)
                if wanted is not None:
                    first = first[in_cells(wanted, key)]
                rows = np.stack([symbol[first + j] for j in range(length + 1)], 1)
                held.append((rows, np.ones(len(rows), np.int64)))
                size += len(rows)
                if size >= HELD_GRAMS:
                    yield from _in_lots(*_summed(held), lots, known.value, starts)
                    held, size = [], 0
        if size:
            yield from _in_lots(*_summed(held), lots, known.value, starts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            columns = (batch.column(c) for c in ("symbols", "n"))
            for lot, short, row, n in zip(batch.column("lot").to_pylist(), batch.column("short").to_pylist(), *columns, strict=True):
                if held and lot != now:
                    yield _frequent(held, names)
                    held = []
                now, n, wide = lot, np.frombuffer(n.as_buffer(), np.int32), 4 * short * (length + 1)
                body = row.as_buffer()
                places = np.frombuffer(body, np.uint32, wide // 4).reshape(length + 1, short)
                whole = np.frombuffer(body, U64, (len(n) - short) * (length + 1), wide).reshape(length + 1, len(n) - short)
                held.append((np.concatenate((known.value[places], whole), 1).T, n))
        if held:
            yield _frequent(held, names)

    packed = train.select("text").mapInArrow(lean(count), "lot long, short long, symbols binary, n binary")
    schema = ", ".join(f"{w} long" for w in [*names, "n"])
    return packed.repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(lean(total), schema)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of symbols, their keys, n): each distinct row once, with the sum of its counts."""
    rows, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    key = row_keys(rows)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    sums = np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    return rows[order[first]], key[first], sums


def _in_lots(
    rows: np.ndarray, key: np.ndarray, n: np.ndarray, lots: int, head: np.ndarray, starts: np.ndarray,
) -> Iterator[pa.RecordBatch]:
    """A row (lot, short, symbols, n) for each lot of keys; its symbols stand column by column.

    The first ``short`` runs are all of symbols of the head and have four-byte places there.
    """
    lot = ((key >> U64(20)) % U64(lots)).astype(np.int64)
    place, held = find(head, starts, rows.ravel())
    place, wide = place.astype(np.uint32).reshape(rows.shape), ~held.reshape(rows.shape).all(1)
    # Runs of equal symbols are compressed well.
    order = np.lexsort((*rows.T[-2::-1], wide, lot))
    rows, place, wide, lot, n = rows[order], place[order], wide[order], lot[order], n[order].astype(np.int32)
    edges = np.append(np.flatnonzero(np.diff(lot, prepend=-1)), len(lot))
    ends = edges[:-1] + np.add.reduceat(~wide, edges[:-1], dtype=np.int64) if len(lot) else edges[:-1]
    yield pa.RecordBatch.from_pydict({
        "lot": pa.array(lot[edges[:-1]]), "short": pa.array(ends - edges[:-1]),
        "symbols": pa.array([
            place[a:m].T.tobytes() + rows[m:b].T.tobytes() for a, m, b in zip(edges, ends, edges[1:])], pa.binary()),
        "n": pa.array([n[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})


def _frequent(held: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    rows, _, n = _summed(held)
    rows, n = rows[n >= MIN_COUNT], n[n >= MIN_COUNT]
    return pa.RecordBatch.from_pydict({
        **{w: pa.array(np.ascontiguousarray(rows[:, j]).view(np.int64)) for j, w in enumerate(names)}, "n": pa.array(n)})


def gram_keys(grams: DataFrame, length: int) -> DataFrame:
    """(gram, context, entry, parent, last, n): the keys of a context and its next symbol.

    ``parent`` is the entry of the symbol after the context's longest suffix; after the
    empty context it is the symbol itself.
    """
    names = [f"w{j}" for j in range(length + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(w)).view(U64) for w in names], 1)
            last = rows[:, -1]
            keys = {"gram": row_keys(rows), "last": last}
            if length:
                keys["context"] = row_keys(rows[:, :-1])
                keys["entry"] = entry_keys(keys["context"], last)
                keys["parent"] = entry_keys(row_keys(rows[:, 1:-1]), last) if length > 1 else last
            yield pa.RecordBatch.from_pydict({
                **{k: pa.array(np.ascontiguousarray(v).view(np.int64)) for k, v in keys.items()}, "n": batch.column("n")})

    kinds = ["gram", "last", *(["context", "entry", "parent"] if length else []), "n"]
    return grams.mapInArrow(lean(run), ", ".join(f"{k} long" for k in kinds))


def head_limit(table: DataFrame, rows: int) -> int:
    """The least count that at most ``rows`` rows reach; all rows of a count are on one side."""
    # One row for each power of a small step, so their number does not grow with the table.
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    sizes = sorted(table.groupBy(step).agg(F.count(F.lit(1)), F.min("n")).collect(), reverse=True)
    held, limit = 0, 1 << 62
    for _, size, least in sizes:
        held += size
        if held > rows:
            break
        limit = least
    return limit


def fit(
    train: DataFrame, depth: int = 2, min_share: float = 0.0, head_share: float = 1e-6, head_rows: int = 1_000_000,
) -> tuple[SuffixTree, DataFrame]:
    """The tree, and the table (symbol, n) of all counts. ``train`` has a ``text`` column.

    Contexts below ``min_share`` of all tokens are left out. ``head_share`` and ``head_rows``
    say what is broadcast; scores do not depend on them.
    """
    counts = checkpoint(symbol_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most 1 / head_share rows.
    head = counts.filter(F.col("n") >= max(1, int(np.ceil(total * head_share)))).toPandas()
    symbol, n = head["symbol"].to_numpy(np.int64).view(U64), head["n"].to_numpy(np.int64)
    order = np.argsort(symbol)
    symbol, n = symbol[order], n[order]
    tree = SuffixTree(int(total), int(distinct), symbol, np.log10(n + 1.0))
    release(train.sparkSession)

    least, tails = max(MIN_COUNT, int(np.ceil(total * min_share))), []
    words = counts.filter(F.col("n") >= MIN_COUNT)
    grams = checkpoint(gram_keys(words.withColumnRenamed("symbol", "w0"), 0))
    before = words.select(F.col("symbol").alias("parent"), ((F.col("n") + 1.0) / (total + distinct + 1.0)).alias("before"))
    for length in range(1, depth + 1):
        held = grams.filter((F.col("n") >= least) & (F.col("last") != int(END))).select(
            F.col("gram").alias("context"), F.col("n").alias("count"))
        if held.isEmpty():
            break
        shorter = cells(grams, "gram")
        wanted = gram_cells(train, length, shorter, int(total))
        grams = checkpoint(gram_keys(gram_counts(train, length, shorter, symbol, wanted), length))
        release(train.sparkSession)
        states, grams = _states(grams, before, held)
        before = grams.select(F.col("entry").alias("parent"), F.col("p").alias("before"))
        entries = grams.filter("log_rest is not null").select(
            F.col("entry").alias("key"), F.col("gain").alias("value"), "n")
        parts = [states.select(F.col("context").alias("key"), F.col("log_rest").alias("value"), F.col("count").alias("n")), entries]
        level = []
        for table in parts:
            limit = head_limit(table, head_rows)
            common = table.filter(F.col("n") >= limit).toArrow()
            key, value = common["key"].to_numpy().view(U64), common["value"].to_numpy()
            order = np.argsort(key)
            level += [key[order], value[order]]
            tails.append(table.filter(F.col("n") < limit).select("key", "value"))
        tree.levels.append(Level(*level))
        release(train.sparkSession)
    if tails:
        tail = tails[0]
        for other in tails[1:]:
            tail = tail.unionAll(other)
        tail = checkpoint(tail)
        if not tail.isEmpty():
            tree.tail, tree.tail_cells = tail, cells(tail)
    return tree, counts


def _states(grams: DataFrame, before: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, count, log_rest) of contexts that diverge, and ``grams`` with p, log_rest and gain.

    ``p`` is the symbol's probability after the context by the longest suffix state;
    ``log_rest`` is null where the context is no state. ``gain`` is what log10 of p has over
    its value by the suffix state and log_rest: a kept symbol is kept after that state, too,
    so the suffix state's value is the one that scoring comes to.
    """
    known = checkpoint(grams.join(before, "parent").join(held, "context", "left"))
    share = F.col("n") / F.col("count")
    sums = known.filter("count is not null").groupBy("context").agg(
        F.max("count").alias("count"), F.count(F.lit(1)).alias("freedom"), F.sum("n").alias("kept"),
        F.sum("before").alias("q"), F.sum(share * F.log(share / F.col("before"))).alias("nats"))
    rest, rest_before = 1 - F.col("kept") / F.col("count"), 1 - F.col("q")
    nats = F.col("nats") + F.when((rest > 0) & (rest_before > 0), rest * F.log(rest / rest_before)).otherwise(F.lit(0.0))
    enough = F.col("freedom") + TEST_WIDTH * F.sqrt(2 * F.col("freedom"))
    left = (F.col("count") - F.col("kept") + SMOOTHING * rest_before) / (F.col("count") + SMOOTHING)
    # A context with nothing left over gives other symbols the least positive share.
    factor = F.when(rest_before > 1e-12, F.greatest(left / rest_before, F.lit(1e-12))).otherwise(F.lit(1e-12))
    states = checkpoint(sums.filter((nats >= MIN_NATS) & (2 * F.col("count") * nats >= enough)).select(
        "context", "count", F.log10(factor).alias("log_rest")))
    smooth = (F.col("n") + SMOOTHING * F.col("before")) / (F.col("count") + SMOOTHING)
    return states, checkpoint(known.join(states.select("context", "log_rest"), "context", "left").select(
        "gram", "last", "entry", "n", "log_rest", F.when(F.col("log_rest").isNotNull(), smooth).otherwise(F.col("before")).alias("p"),
        (F.log10(smooth) - F.log10("before") - F.col("log_rest")).alias("gain")))


def token_logs(
    tree: SuffixTree, symbol: np.ndarray, doc: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of count + 1, in the head, log10 probability) of each token, (token, key) of open lookups.

    Open lookups are what the broadcast part does not have and the counts of all words or
    the tail may: each adds its value to the token's log10 probability, the count of a word
    outside the head to its log10 of count + 1 as well, which is 0 here.
    """
    place, in_head = find(tree.head, tree.head_at, symbol)
    log_count = np.where(in_head, tree.head_log[place] if len(tree.head) else 0.0, 0.0)
    log_p = log_count - tree.log_all
    token, wanted = [np.flatnonzero(~in_head)], [symbol[~in_head]]

    def look(keys: np.ndarray, starts: np.ndarray, values: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        place, held = find(keys, starts, key)
        log_p[at[held]] += values[place[held]]
        open_ = ~held & in_cells(tree.tail_cells, key)
        token.append(at[open_])
        wanted.append(key[open_])
        return held | open_

    for length, level in enumerate(tree.levels, 1):
        at, context = contexts(symbol, doc, length)
        state = look(level.context, level.context_at, level.log_rest, at, context)
        # Only states have entries.
        at, context = at[state], context[state]
        look(level.entry, level.entry_at, level.gain, at, entry_keys(context, symbol[at]))
    return log_count, in_head, log_p, np.concatenate(token), np.concatenate(wanted)


FIGURES = "doc_id long, n_tokens long, n_known long, base double, score double"
FIGURE_TYPE = pa.struct([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
#: A row for each text with its figures so far, or one for the open lookups of a file's texts in
#: one lot: their keys, and the rows of their texts, counted from ``row``.
SCORED = f"file long, row long, lot long, figures struct<{FIGURES}>, size long, planes array<binary>"


def _packed_lookups(file: int, key: np.ndarray, row: np.ndarray, lots: int) -> pa.RecordBatch:
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    lot, edges = _lot_edges(key, lots)
    least = row.min()
    return pa.RecordBatch.from_pydict({
        "file": pa.array(np.full(len(lot), file)), "row": pa.array(np.full(len(lot), least)), "lot": pa.array(lot),
        "figures": pa.nulls(len(lot), FIGURE_TYPE),
        "size": pa.array(np.diff(edges)),
        "planes": pa.array([_planes(key[a:b], row[a:b] - least) for a, b in zip(edges, edges[1:])], pa.list_(pa.binary()))})


def _met(scanned: pa.Table, values: pa.Table) -> pa.Table:
    """(file, row, figures) of a lot's texts, and what each text's lookups in the lot add."""
    schema = pa.schema([("file", pa.int64()), ("row", pa.int64()), *FIGURE_TYPE])
    own = scanned.filter(pc.is_null(scanned["size"]))
    parts = [pa.Table.from_arrays([own["file"], own["row"], *own["figures"].combine_chunks().flatten()], schema=schema)]
    key = values["symbol"].to_numpy().view(U64)
    order = np.argsort(key)
    key, value, word = key[order], values["value"].to_numpy()[order], values["word"].to_numpy()[order]
    starts = starts_of(key)
    lookups = scanned.filter(pc.is_valid(scanned["size"]))
    for file, first, size, planes in zip(*(lookups[c].to_pylist() for c in ("file", "row", "size", "planes")), strict=True):
        wanted, row = _of_planes(size, planes)
        place, found = find(key, starts, wanted)
        place, (row, at) = place[found], np.unique(row[found], return_inverse=True)
        sums = lambda x: np.bincount(at, weights=x, minlength=len(row))  # noqa: E731, B023
        none = pa.nulls(len(row), pa.int64())
        parts.append(pa.Table.from_arrays([
            pa.array(np.full(len(row), file)), pa.array(row.astype(np.int64) + first), none, none,
            pa.array(sums(word[place]).astype(np.int64)), pa.array(sums(value[place] * word[place])),
            pa.array(sums(value[place]))], schema=schema))
    return pa.concat_tables(parts).combine_chunks()


def score(docs: DataFrame, tree: SuffixTree, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(tree.parts())
    lots = max(LEAST_SCORE_LOTS, LOTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_locator(docs.select(id_col, text_col), "_at").select(
        F.xxhash64("_at.file").alias("file"), F.col("_at.row").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = SuffixTree.of_parts(shared.value), {}, 0
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                part, n = batch.slice(first, len(texts)), len(texts)
                symbol, doc, n_tokens = tokens(texts)
                log_count, in_head, log_p, token, wanted = token_logs(model, symbol, doc)
                sums = lambda x: np.bincount(doc, weights=x, minlength=n)  # noqa: E731, B023
                file, row = np.asarray(part.column("file")), np.asarray(part.column("row"))
                figures = pa.StructArray.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(sums(in_head).astype(np.int64)),
                     pa.array(sums(log_count) - n_tokens * model.log_all), pa.array(sums(log_p))], fields=list(FIGURE_TYPE))
                # Texts are dealt over the lots.
                lot = (mix(row.astype(U64) ^ END) % U64(lots)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "file": part.column("file"), "row": part.column("row"), "lot": pa.array(lot), "figures": figures,
                    "size": pa.nulls(n, pa.int64()), "planes": pa.nulls(n, pa.list_(pa.binary()))})
                owner = doc[token]
                for f in np.unique(file[owner]):
                    mine = file[owner] == f
                    held.setdefault(f, []).append((wanted[mine], row[owner[mine]]))
                size += len(wanted)
                if size >= HELD_GRAMS:
                    for f, x in held.items():
                        yield _packed_lookups(f, *(np.concatenate(c) for c in zip(*x)), lots)
                    held, size = {}, 0
        for f, x in held.items():
            yield _packed_lookups(f, *(np.concatenate(c) for c in zip(*x)), lots)

    scanned = rows.mapInArrow(lean(scan), SCORED)
    values = counts.select("symbol", F.log10(F.col("n") + 1).alias("value"), F.lit(1).alias("word"))
    if tree.tail is not None:
        values = values.unionAll(tree.tail.toDF("symbol", "value").withColumn("word", F.lit(0)))
    values = values.withColumn("lot", F.expr(f"shiftrightunsigned(shiftrightunsigned(symbol, 44) * {lots}L, 20)"))
    met = scanned.groupBy("lot").cogroup(values.groupBy("lot")).applyInArrow(_met, f"file long, row long, {FIGURES}")
    return met.groupBy("file", "row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("file", "row")


def train_rows(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    return docs.filter(training).select(F.col(text_col).alias("text"))
