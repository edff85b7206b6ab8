"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The pieces come from a public model file; nothing is trained. All pieces that match at a
place are edges of a lattice over the text's bytes, a character without a piece of its own
is a chain of byte pieces. Forward filtering sums the weights of all paths to each node,
backward sampling walks from the end and draws each edge in proportion to the paths
through it. The result is an exact draw from all segmentations.

A merge-based model has no piece probabilities, only an order; a piece of rank r weighs
(1 + r) ** -alpha, pieces without a rank (bytes, runs of spaces) as the last rank. A large
``alpha`` tends to the heaviest segmentation, a small one to uniform draws.

No piece has a space after another character, so paths cannot cross the place before a
space: the lattice of a text is a chain of small ones, one for each word with the spaces
before it, and equal ones of a slice are filtered once, some different words at a time, so
a task holds few lattices whatever the length of its texts; only a single word without an
end grows it. Draws are numbered: the k-th draw of the j-th word of a row comes from a hash
of (seed, row key, j, k), so a row has the same segmentation in every run, on any cluster.

Decoding joins the pieces' bytes and takes off the space that encoding puts first; it gives
back every text exactly: the marker that stands for a space in the pieces is spelt in bytes
where a text contains it. A null text has null pieces; an empty one has the first space
only. A null key counts as -1. Repeated rows get the same segmentation; an empty table gives
no rows. Columns other than key and text are kept by ``encode`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tauframe.llm.storage import bound_batches, lean
from tauframe.llm.textvec import U64, Words, mix, raw_bytes, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
SPACE = 32
#: Bytes handled at once: the more, the more often a word occurs among them.
SLICE_BYTES = 500_000
#: Bytes of different words filtered at once; a longer word is filtered alone.
LATTICE_BYTES = 50_000
#: Pieces decoded at once; a longer row is decoded whole.
SLICE_PIECES = 200_000
#: Draws of one word are this far apart before they are mixed.
STEP = 0xD1B54A32D192ED03


@dataclass
class Pieces:
    """Bytes and ranks of all pieces by id; ``byte_id`` has the id of each byte."""

    surface: list[bytes | None]
    rank: np.ndarray
    byte_id: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """Read a model file on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        surface: list[bytes | None] = [None] * n
        rank, byte_id = np.full(n, n, dtype=np.int64), np.full(256, -1, dtype=np.int32)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                surface[i], byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                surface[i] = piece.replace(MARKER, " ").encode()
                rank[i] = min(n, max(0, round(-model.get_score(i))))
        if (byte_id < 0).any():
            raise ValueError("lossless decoding needs a model with byte pieces")
        return cls(surface, rank, byte_id)


class Trie:
    """Pieces by their bytes: next states, state 0 the root.

    Most states have a single next one; only those with more have a row in ``table``.
    """

    def __init__(self, pieces: Pieces):
        bytes_of = {int(i) for i in pieces.byte_id}
        states: dict[bytes, int] = {b"": 0}
        ends, moves = {}, []
        self.alone = np.ones(256, dtype=bool)
        for i, surface in enumerate(pieces.surface):
            if surface is None or i in bytes_of:
                continue
            self.alone[list(surface)] = False
            at = 0
            for k in range(1, len(surface) + 1):
                prefix = surface[:k]
                to = states.get(prefix)
                if to is None:
                    to = states[prefix] = len(states)
                    moves.append((at, surface[k - 1], to))
                at = to
            ends[at] = i
        at, byte, to = np.array(moves).T
        many = np.bincount(at, minlength=len(states)) > 1
        self.row = np.where(many, np.cumsum(many), 0).astype(np.int32)
        self.table = np.zeros((many.sum() + 1, 256), dtype=np.int32)
        self.table[self.row[at], byte] = np.where(many[at], to, 0)
        lone = ~many[at]
        self.only = np.full(len(states), -1, dtype=np.int16)
        self.only[at[lone]] = byte[lone]
        self.only_next = np.zeros(len(states), dtype=np.int32)
        self.only_next[at[lone]] = to[lone]
        self.piece = np.full(len(states), -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states of ``state`` by ``byte``, 0 for none."""
        return np.where(self.only[state] == byte, self.only_next[state], self.table[self.row[state], byte])


def _segments(data: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Where lattices begin: before the first space of a run, around bytes of no piece."""
    cut = np.zeros(len(data), dtype=bool)
    cut[offsets[:-1]] = True
    space = data == SPACE
    cut[1:] |= space[1:] & ~space[:-1]
    # Only ASCII controls: bytes of a longer character stay together.
    single = alone[data] & (data < 128)
    cut[1:] |= single[1:] | single[:-1]
    return np.flatnonzero(cut)


def _edges(trie: Trie, byte_id: np.ndarray, body: np.ndarray, last: np.ndarray):
    """(first byte, byte after, piece) of every match in ``body``; ``last`` ends each byte's word."""
    start = np.flatnonzero((body & 0xC0) != 0x80)
    width = np.diff(np.append(start, len(body)))
    state, at, owner = np.zeros(len(start), np.int32), start.copy(), np.arange(len(start))
    found, single = [], np.zeros(len(start), dtype=bool)
    while len(owner):
        state = trie.step(state, body[at])
        alive = state > 0
        state, at, owner = state[alive], at[alive] + 1, owner[alive]
        piece = trie.piece[state]
        hit = piece >= 0
        found.append((start[owner[hit]], at[hit], piece[hit]))
        single[owner[hit & (at - start[owner] == width[owner])]] = True
        more = at < last[start[owner]]
        state, at, owner = state[more], at[more], owner[more]
    spelt = np.flatnonzero(~single)
    byte = np.repeat(start[spelt], width[spelt]) + np.arange(width[spelt].sum()) - np.repeat(np.cumsum(width[spelt]) - width[spelt], width[spelt])
    found.append((byte, byte + 1, byte_id[body[byte]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _draw(
    body: np.ndarray, size: np.ndarray, kind: np.ndarray, state: np.ndarray, pieces: Pieces, trie: Trie, alpha: float,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """A draw for each of ``kind``, from the last piece to the first: (who has a k-th, which).

    ``body`` has the bytes of different words of ``size``, ``kind`` numbers them.
    """
    head = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)

    # A word of n bytes has n + 1 nodes.
    origin = head + np.arange(len(size))
    first, after, piece = _edges(trie, pieces.byte_id, body, (head + size)[word])
    owner = word[first]
    source, target = first + owner, after + owner
    depth = after - head[owner]
    # By depth, then node, then length: one whole number, as pieces are short.
    order = np.argsort((depth * (len(body) + len(size)) + target) * 256 + target - source)
    source, target, piece, depth = source[order], target[order], piece[order], depth[order]
    log_weight = -alpha * np.log1p(pieces.rank[piece])
    log_sum = np.full(len(body) + len(size), -np.inf)
    log_sum[origin] = 0
    share = np.empty(len(source))
    opens = np.ones(len(source), dtype=bool)
    opens[1:] = target[1:] != target[:-1]
    at_depth = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
    for low, high in zip(at_depth[:-1], at_depth[1:], strict=True):
        if low == high:
            continue
        value = log_sum[source[low:high]] + log_weight[low:high]
        groups = np.flatnonzero(opens[low:high])
        members = np.diff(np.append(groups, high - low))
        top = np.maximum.reduceat(value, groups)
        weight = np.exp(value - np.repeat(top, members))
        total = np.add.reduceat(weight, groups)
        log_sum[target[low:high][groups]] = top + np.log(total)
        share[low:high] = weight / np.repeat(total, members)
    group_first = np.flatnonzero(opens)
    group_last = np.append(group_first[1:], len(source)) - 1
    group_of = np.zeros(len(log_sum), dtype=np.int64)
    group_of[target[group_first]] = np.arange(len(group_first))
    # Each node's shares add up on their own, so draws do not depend on what else is in the lot.
    rung = np.flatnonzero(~opens)
    place = rung - group_first[np.cumsum(opens)[rung] - 1]
    ladder = share
    for k in range(1, int(place.max(initial=0)) + 1):
        at = rung[place == k]
        ladder[at] += ladder[at - 1]

    node, active = (origin + size)[kind], np.arange(len(kind))
    steps, home = [], origin[kind]
    while len(active):
        k = len(steps) + 1
        draw = (mix(state[active] + U64(k * STEP % 2**64)) >> U64(11)).astype(np.float64) / (1 << 53)
        group = group_of[node[active]]
        # Few edges enter a node, so steps up the ladder beat a search of all of it.
        edge = group_first[group]
        below = np.flatnonzero((edge < group_last[group]) & (ladder[edge] <= draw))
        while len(below):
            edge[below] += 1
            below = below[(edge[below] < group_last[group[below]]) & (ladder[edge[below]] <= draw[below])]
        steps.append((active, piece[edge]))
        node[active] = source[edge]
        active = active[node[active] != home[active]]
    return steps


def _sample_words(
    data: np.ndarray, begin: np.ndarray, state: np.ndarray, pieces: Pieces, trie: Trie, alpha: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, number of each word's ids); words begin at ``begin``."""
    end = np.append(begin[1:], len(data))
    size = end - begin
    # Equal words are filtered once. Equal hashes are compared byte by byte.
    hashes = Words(data, data, begin, begin, end, begin, size).span_hash(begin, end)
    _, pick, kind = np.unique(hashes, return_index=True, return_inverse=True)
    if not np.array_equal(size[pick][kind], size) or not np.array_equal(
            data, data[np.repeat(begin[pick][kind] - begin, size) + np.arange(len(data))]):
        pick, kind = np.arange(len(begin)), np.arange(len(begin))

    # Short words first, as the longest of a lot tells how deep its lattices are.
    order = np.argsort(size[pick], kind="stable")
    pick, place = pick[order], np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    kind = place[kind]
    lot = (np.cumsum(size[pick]) - size[pick]) // LATTICE_BYTES
    edges = np.append(np.flatnonzero(np.diff(lot, prepend=-1)), len(lot))
    members = np.argsort(kind, kind="stable")
    member_edges = np.searchsorted(kind[members], edges)

    count, steps = np.zeros(len(begin), dtype=np.int64), []
    for i in range(len(edges) - 1):
        words, who = pick[edges[i] : edges[i + 1]], members[member_edges[i] : member_edges[i + 1]]
        wide = size[words]
        body = data[np.repeat(begin[words] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())]
        for k, (some, piece) in enumerate(_draw(body, wide, kind[who] - edges[i], state[who], pieces, trie, alpha)):
            count[who[some]] += 1
            steps.append((k, who[some].astype(np.int32), piece))
    last = np.cumsum(count) - 1
    ids = np.empty(int(count.sum()), dtype=np.int32)
    for k, who, piece in steps:
        ids[last[who] - k] = piece
    return ids, count


def sample(texts: pa.Array, keys: np.ndarray, pieces: Pieces, trie: Trie, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of each text's ids); texts without nulls."""
    data, offsets = raw_bytes(pc.binary_join_element_wise(" ", texts, ""))
    begin = _segments(data, offsets, trie.alone)
    doc_first = np.searchsorted(begin, offsets[:-1])
    base = mix(keys.astype(np.int64).view(U64) ^ mix(np.array([seed], dtype=np.int64).view(U64)))
    found, total = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
    edges = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data), SLICE_BYTES)), len(begin)))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        first, after = begin[low], begin[high] if high < len(begin) else len(data)
        doc = np.searchsorted(offsets, begin[low:high], "right") - 1
        within = np.arange(low, high) - doc_first[doc]
        state = mix(base[doc] + (within.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
        ids, count = _sample_words(data[first:after], begin[low:high] - first, state, pieces, trie, alpha)
        found.append(ids)
        total += np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
    return np.concatenate(found), total


def encode(
    docs: DataFrame, model: str = MODEL, key_col: str = "doc_id", text_col: str = "text",
    out_col: str = "piece_ids", alpha: float = 1.0, seed: int = 17,
) -> DataFrame:
    """``docs`` with the sampled piece ids as column ``out_col``, in place of one of that name."""
    bound_batches(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c != out_col])
    pieces = Pieces.load(model)
    parts = docs.sparkSession.sparkContext.broadcast((pieces, Trie(pieces)))
    text_at, key_at = docs.columns.index(text_col), docs.columns.index(key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trie = parts.value
        for batch in batches:
            keys = np.asarray(pc.fill_null(batch.column(key_at).cast(pa.int64()), -1))
            for first, texts in text_slices(batch.column(text_at), SLICE_BYTES):
                part = batch.slice(first, len(texts))
                ids, count = sample(texts, keys[first : first + len(texts)], own, trie, alpha, seed)
                edges = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                lists = pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))
                lists = pc.if_else(pc.is_valid(part.column(text_at)), lists, pa.nulls(len(texts), lists.type))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[f"c{i}" for i in range(len(part.columns) + 1)])

    schema = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)],
                         StructField(f"c{len(docs.columns)}", ArrayType(IntegerType()))])
    return docs.mapInArrow(lean(run), schema).toDF(*docs.columns, out_col)


def _without_first(joined: pa.Array) -> pa.Array:
    """Each byte string less its first byte, as text."""
    data, offsets = raw_bytes(joined)
    filled = np.diff(offsets) > 0
    upto = (offsets - np.concatenate(([0], np.cumsum(filled)))).astype(np.int32)
    rest = np.delete(data, offsets[:-1][filled])
    return pa.Array.from_buffers(pa.string(), len(joined), [None, pa.py_buffer(upto), pa.py_buffer(rest)])


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its pieces as column ``out_col``, in place of one of that name."""
    encoded = encoded.select([c for c in encoded.columns if c != out_col])
    surfaces = encoded.sparkSession.sparkContext.broadcast([s or b"" for s in Pieces.load(model).surface])
    ids_at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(surfaces.value, pa.binary())
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(ids_at)), 0))
            lot = np.cumsum(sizes) // SLICE_PIECES
            bounds = np.append(np.flatnonzero(np.diff(lot, prepend=-1)), len(lot))
            for first, after in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(first, after - first)
                ids = part.column(ids_at)
                edges = pa.array(np.concatenate(([0], np.cumsum(sizes[first:after]))), pa.int32())
                parts = pa.ListArray.from_arrays(edges, table.take(ids.flatten()))
                texts = pc.if_else(
                    pc.is_valid(ids), _without_first(pc.binary_join(parts, b"")), pa.nulls(len(ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[f"c{i}" for i in range(len(part.columns) + 1)])

    schema = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(encoded.schema)],
                         StructField(f"c{len(encoded.columns)}", StringType())])
    return encoded.mapInArrow(lean(run), schema).toDF(*encoded.columns, out_col)


def lossless(text: str, decoded: str):
    """Whether a text and its decoded pieces are the same, nulls included."""
    return F.col(text).eqNullSafe(F.col(decoded))
