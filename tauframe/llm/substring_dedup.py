"""Removal of long passages that occur again, on a compacted de Bruijn graph of words.

Edges. Every run of ``window`` consecutive words of a document is an edge of the graph. Of
its runs of ``ANCHOR`` words, the one with the smallest hash (the leftmost of equals) is the
edge's anchor: equal edges have equal anchors. Consecutive edges of a document with one
anchor travel as one stretch, about a twelfth of all words, named by the anchor's hash and
a hash of all words of the stretch.

Compaction. Stretches are grouped by anchor, combined in the map tasks first. An anchor met
once has no repeated edge. If all stretches of an anchor hold the same words, they form
a path that branches nowhere: each of its edges occurs as often as the anchor, and the
path stays compacted. Only anchors with differing stretches, at the branches of the
graph, are opened: their edges are counted one by one by two 64-bit hashes. Joins carry
both findings back to the documents, where paths and edges that touch become spans.

Verification. A document's words are read again at their source coordinates; a word
goes if an edge over it lies on a repeated path or was counted twice. Equality rests on
128 bits (anchor and stretch, or both hashes of an edge) over 64-bit word hashes; bytes
of partners are not brought together.

Hot passages. Joins send anchors and edges with more than one in ``HEAVY`` of all rows
by broadcast, of which there can be no more than ``HEAVY``; the others meet in a shuffle with
a bounded share of the rows for each key. A list for a document is never longer than the
document. There is no cap on passages, lengths or numbers of copies.

Choices: words are compared as they are; white space is not. A null text has no words. A
text shorter than the window keeps all. A window that repeats inside one document, also
overlapping itself, counts. Null ids and repeated rows are rows like others (a repeated row
of ``window`` words or more loses them all). An empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauframe.llm.storage import as_scan, bound_batches, checkpoint, delete_folder, release, shared_folder, with_locator
from tauframe.llm.textvec import U64, Words, mix, text_slices, windows, words_of

ANCHOR = 12
#: A key with more than this part of all rows is heavy; there are at most so many.
HEAVY = 10_000

_BASE = U64(0xD6E8FEB86659FD93)
_SALT = U64(0xA0761D6478BD642F)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            for name, base in (("up", _BASE), ("down", U64(pow(int(_BASE), -1, 2**64)))):
                powers = np.full(max(n + 1, 1 << 17), base, dtype=U64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up, cls.down


class _Runs:
    """Hashes of runs of words from prefix sums of a polynomial."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _Powers.upto(len(hashes))
        self.prefix = np.zeros(len(hashes) + 1, dtype=U64)
        np.cumsum((hashes | U64(1)) * self.up[: len(hashes)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.prefix[end] - self.prefix[start]) * self.down[start]
        return mix(value ^ ((end - start).astype(U64) << U64(40)))


@dataclass
class Stretches:
    """Edges of a run of texts: ``first`` word, ``owner`` stretch; a stretch's text, anchor and words."""

    words: Words
    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def stretches(texts: pa.Array, window: int) -> Stretches:
    words = words_of(texts, lower=False)
    hashes = words.hashes()
    n = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    first = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :]) if n > 0 else none
    if not len(first):
        return Stretches(words, hashes, none, none, none, np.zeros(0, U64), np.zeros(0, U64))
    size = min(ANCHOR, window)
    # Hashes of anchors that cross texts are never looked at: an edge lies in one text.
    _, short = windows(hashes, np.zeros(len(hashes), np.int8), size)
    wide = window - size + 1
    least = np.empty(len(first), dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(short, wide)
    for at in range(0, len(first), 1 << 15):
        some = first[at : at + (1 << 15)]
        least[at : at + len(some)] = some + view[some].argmin(axis=1)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(first)) - 1
    return Stretches(
        words, hashes, first, np.cumsum(new) - 1, words.doc[first[at]], short[least[at]],
        _Runs(hashes)(first[at], first[last] + window))


def edge_hashes(found: Stretches, edges: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the words of the edges at ``edges``."""
    start = found.first[edges]
    one = _Runs(found.hashes)(start, start + window)
    other = _Runs(mix(found.hashes ^ _SALT))(start, start + window)
    return one, other


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """Values grouped by ``owner``, which ascends, as ``n`` lists."""
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))


def _kept_text(words: Words, doc: int, kept: np.ndarray, edges: np.ndarray) -> bytes:
    low, high = edges[doc], edges[doc + 1]
    raw = words.raw
    return b" ".join(raw[words.start[i] : words.end[i]].tobytes() for i in range(low, high) if kept[i])


def _sign(docs: DataFrame, window: int) -> DataFrame:
    """(at, doc_id, n_words, whole_sha256, anchors, contents) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                part, n = batch.slice(first, len(texts)), len(texts)
                found = stretches(texts, window)
                words = found.words
                edges = np.concatenate(([0], np.cumsum(words.count)))
                every = np.ones(len(words.start), dtype=bool)
                yield pa.RecordBatch.from_pydict({
                    "at": part.column("at"), "doc_id": part.column("doc_id"), "n_words": pa.array(words.count, pa.int64()),
                    "whole_sha256": [hashlib.sha256(_kept_text(words, d, every, edges)).hexdigest() for d in range(n)],
                    "anchors": _lists(found.doc, n, found.anchor), "contents": _lists(found.doc, n, found.content)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, (
        f"at struct<file:string,row:long>, doc_id {kind}, n_words long, whole_sha256 string, "
        "anchors array<long>, contents array<long>"))


def _isin(values: np.ndarray, owner: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each value stands in the list of its owner; owners ascend."""
    flag = np.zeros(len(values), dtype=bool)
    edges = np.searchsorted(owner, np.arange(len(lists) + 1))
    for d in range(len(lists)):
        low, high = edges[d], edges[d + 1]
        if low < high and lists[d].is_valid:
            held = np.asarray(lists[d].values).view(U64)
            if len(held):
                flag[low:high] = np.isin(values[low:high], held)
    return flag


def _open_edges(texts: DataFrame, window: int) -> DataFrame:
    """(key, one, other, n): hashes of the edges of each document's open anchors, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column("text")):
                rows, n = batch.slice(first, len(part)), len(part)
                found = stretches(part, window)
                chosen = _isin(found.anchor, found.doc, rows.column("open"))
                edges = np.flatnonzero(chosen[found.owner])
                one, other = edge_hashes(found, edges, window)
                doc = found.doc[found.owner[edges]]
                order = np.lexsort((other, one, doc))
                doc, one, other = doc[order], one[order], other[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(doc)))
                yield pa.RecordBatch.from_pydict({
                    "key": rows.column("key"), "one": _lists(doc[at], n, one[at]),
                    "other": _lists(doc[at], n, other[at]), "n": _lists(doc[at], n, count.astype(np.int64))})

    return texts.mapInArrow(run, "key long, one array<long>, other array<long>, n array<long>")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, kept_sha256, spans) of documents with repeated paths or edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column("text")):
                rows, n = batch.slice(first, len(part)), len(part)
                found = stretches(part, window)
                words = found.words
                gone = _isin(found.anchor, found.doc, rows.column("paths"))[found.owner]
                rest = np.flatnonzero(~gone)
                one, _ = edge_hashes(found, rest, window)
                gone[rest] = _isin(one, found.doc[found.owner[rest]], rows.column("edges"))
                change = np.zeros(len(words.start) + 1, dtype=np.int64)
                np.add.at(change, found.first[gone], 1)
                np.add.at(change, found.first[gone] + window, -1)
                removed = np.cumsum(change[:-1]) > 0
                edges = np.concatenate(([0], np.cumsum(words.count)))
                total = np.concatenate(([0], np.cumsum(removed)))
                # Spans in words of their document: removed runs, cut where a text ends.
                begin = removed.copy()
                begin[1:] &= ~removed[:-1] | (words.doc[1:] != words.doc[:-1])
                end = removed.copy()
                end[:-1] &= ~removed[1:] | (words.doc[1:] != words.doc[:-1])
                low, high = np.flatnonzero(begin), np.flatnonzero(end) + 1
                span_doc = words.doc[low]
                shift = edges[span_doc]
                yield pa.RecordBatch.from_pydict({
                    "key": rows.column("key"), "n_removed": pa.array(total[edges[1:]] - total[edges[:-1]], pa.int64()),
                    "kept_sha256": [hashlib.sha256(_kept_text(words, d, ~removed, edges)).hexdigest() for d in range(n)],
                    "starts": _lists(span_doc, n, (low - shift).astype(np.int64)),
                    "ends": _lists(span_doc, n, (high - shift).astype(np.int64))})

    return texts.mapInArrow(run, "key long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>")


def _join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``counted`` (on, n, ...) without a hot key in the shuffle."""
    heavy = F.col("n") * HEAVY > total
    hot = F.broadcast(counted.filter(heavy).drop("n"))
    some = rows.join(hot, on)
    rest = rows.join(F.broadcast(counted.filter(heavy).select(*on)), on, "left_anti").join(
        counted.filter(~heavy).drop("n"), on)
    return some.unionByName(rest)


def repeated_spans(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: at, doc_id, n_words, n_removed, kept_sha256, starts, ends.

    ``starts`` and ``ends`` (exclusive) give the removed runs of words, counted from 0;
    ``kept_sha256`` is that of the kept words joined by single spaces.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = as_scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    located = with_locator(docs, "at")
    folder = shared_folder(spark, "stretches")
    _sign(located, window).withColumn("key", F.monotonically_increasing_id()).write.parquet(folder)
    signed = spark.read.parquet(folder)
    texts = located.select("at", "text")

    met = signed.select("key", F.explode(F.arrays_zip("anchors", "contents")).alias("r")).select(
        "key", F.col("r.anchors").alias("anchor"), F.col("r.contents").alias("content"))
    counted = checkpoint(met.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("_low"), F.max("content").alias("_high")).filter("n > 1").select(
        "anchor", "n", (F.col("_low") != F.col("_high")).alias("branches")))
    total = signed.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    anchor = F.col("anchor")
    own = signed.select("key", F.explode(F.array_distinct("anchors")).alias("anchor"))
    found = checkpoint(_join_counted(own, counted, ["anchor"], total).groupBy("key").agg(
        F.collect_list(F.when(~F.col("branches"), anchor)).alias("paths"),
        F.collect_list(F.when(F.col("branches"), anchor)).alias("open")).join(signed.select("key", "at"), "key"))
    release(spark)

    opened = shared_folder(spark, "edges")
    _open_edges(found.filter("size(open) > 0").select("at", "key", "open").join(texts, "at").select(
        "key", "open", "text"), window).write.parquet(opened)
    edges = spark.read.parquet(opened)
    each = edges.select("key", F.explode(F.arrays_zip("one", "other", "n")).alias("r")).select("key", "r.*")
    twice = checkpoint(each.groupBy("one", "other").agg(F.sum("n").alias("n")).filter("n > 1"))
    many = edges.agg(F.coalesce(F.sum(F.size("one")), F.lit(0))).first()[0]
    repeated = checkpoint(_join_counted(each.drop("n"), twice, ["one", "other"], many).groupBy("key").agg(
        F.collect_list("one").alias("edges")))
    delete_folder(spark, opened)
    release(spark)

    touched = found.drop("open").join(repeated, "key", "left").filter("size(paths) > 0 OR edges IS NOT NULL")
    cut = checkpoint(_cut(touched.join(texts, "at").select("key", "paths", "edges", "text"), window))
    result = checkpoint(signed.select("key", "at", "doc_id", "n_words", "whole_sha256").join(cut, "key", "left").select(
        "at", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("starts", F.expr("cast(array() AS array<bigint>)")).alias("starts"),
        F.coalesce("ends", F.expr("cast(array() AS array<bigint>)")).alias("ends")))
    delete_folder(spark, folder)
    return result
