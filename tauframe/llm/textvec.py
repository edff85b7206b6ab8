"""Vectorised words, hashes and shingles of a batch of texts.

Everything works on the UTF-8 bytes of an Arrow string array with numpy; no loop
runs over words. A word is a maximal run of bytes other than space and the
control characters 9 to 13. Word identity is a 64-bit hash: a polynomial in an odd
base over the bytes, modulo 2**64, through prefix sums, then a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes handled at once; a single longer text is still handled whole.
SLICE_BYTES = 500_000

_BASE = U64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, SLICE_BYTES + 1)
            inverse = U64(pow(int(_BASE), -1, 2**64))
            for name, base in (("up", _BASE), ("down", inverse)):
                powers = np.full(size, base, dtype=U64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a run of texts; ``doc`` numbers the texts from 0."""

    raw: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray
    prefix: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each [start, end)."""
        up, down = _Powers.upto(len(self.data))
        if self.prefix is None:
            self.prefix = np.zeros(len(self.data) + 1, dtype=U64)
            np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=self.prefix[1:])
        value = (self.prefix[end] - self.prefix[start]) * down[start]
        return mix(value ^ ((end - start).astype(U64) << U64(48)))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, array without nulls) pieces of at most ``limit`` bytes or one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    first = 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    wide = texts.type in (pa.large_string(), pa.large_binary())
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, at.astype(np.int64) - int(at[0])


def words_of(texts: pa.Array, lower: bool) -> Words:
    """Words of texts without nulls; ``lower`` folds A to Z only."""
    raw, offsets = raw_bytes(texts)
    data = _LOWER[raw] if lower else raw
    solid = ~_SEP[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    upto = np.searchsorted(start, offsets)
    count = np.diff(upto)
    return Words(raw, data, offsets, start, end, np.repeat(np.arange(len(count)), count), count)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``k`` words inside one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = np.zeros(len(at), dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * _BASE + hashes[at + j] * U64(2 * j + 1)
    return at, mix(total ^ U64(k))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every text's distinct shingles, sorted by text, then hash.

    A text with fewer than ``k`` words but at least one has its whole sequence as
    the only shingle; a text without words has none.
    """
    hashes = words.hashes()
    at, shingle = windows(hashes, words.doc, k)
    doc = words.doc[at]
    for d in np.flatnonzero((words.count > 0) & (words.count < k)):
        lo = np.searchsorted(words.doc, d)
        n = int(words.count[d])
        _, whole = windows(hashes[lo : lo + n], words.doc[lo : lo + n], n)
        doc, shingle = np.append(doc, d), np.append(shingle, whole)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[keep], shingle[keep]
