"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by figures of
its characters and words and a small layer on them; gated attention (a tanh branch times
a sigmoid branch) weighs the passages, and a logistic unit scores the weighted mean of
their encodings. Only documents have labels, so the attention learns which passages
decide. Weights are fitted on the driver with numpy from a bounded sample of labelled
rows: ``max_rows`` documents at most, in the order of a hash of their id, as long as their
passages number ``max_passages`` in all. Scoring is one narrow pass over all texts.

Choices: a text without words, or null, is one passage of zeros. Rows with null labels
teach nothing; of several labels for one id the mean decides. With no labelled rows, or
one class only, every score is the share of label 1 (0.5 without rows). Repeated rows
are scored each; an empty table gives no rows. Only id and text are read of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauframe.llm.storage import bound_batches, checkpoint, lean
from tauframe.llm.textvec import text_slices, words_of

#: Words in a passage.
PASSAGE = 64
#: Characters counted, one figure each.
CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "stop": b".", "comma": b",;:", "loud": b"!?",
    "symbol": b"#*$%&|<>@=_~^\\", "quote": b"\"'()[]{}-/+", "line": b"\n",
}
FIGURES = [
    "log_words", "word_bytes", *CLASSES, "high", "repeats", "distinct", "short", "bare"]


def passage_figures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text of each passage, figures of each passage); a text has one passage at least."""
    words = words_of(texts, lower=False)
    hashes = words.hashes()
    number = np.maximum(1, -(-words.count // PASSAGE))
    base = np.cumsum(number) - number
    first_word = np.cumsum(words.count) - words.count
    within = np.arange(len(words.doc)) - first_word[words.doc]
    owner = base[words.doc] + within // PASSAGE
    total = int(number.sum())
    add = lambda x: np.bincount(owner, weights=x, minlength=total)
    n = add(np.ones(len(owner)))
    length = words.end - words.start
    size = np.maximum(1.0, add(length))

    upto = np.zeros(len(words.raw) + 1, dtype=np.int64)

    def share(flags: np.ndarray) -> np.ndarray:
        np.cumsum(flags, out=upto[1:])
        return add(upto[words.end] - upto[words.start]) / size

    columns = [np.log1p(n), size / np.maximum(1, n)]
    for name, members in CLASSES.items():
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        if name == "line":
            np.cumsum(table[words.raw], out=upto[1:])
            # Breaks between a word and the next one of its passage.
            gap = np.zeros(len(owner))
            if len(owner) > 1:
                gap[:-1] = np.where(owner[1:] == owner[:-1], upto[words.start[1:]] - upto[words.end[:-1]], 0)
            columns.append(add(gap) / np.maximum(1, n))
        else:
            columns.append(share(table[words.raw]))
    columns.append(share(words.raw >= 128))
    again = np.zeros(len(owner))
    again[1:] = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    columns.append(add(again) / np.maximum(1, n))
    order = np.lexsort((hashes, owner))
    new = np.ones(len(owner))
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    columns.append(np.bincount(owner[order], weights=new, minlength=total) / np.maximum(1, n))
    columns.append(add(length <= 2) / np.maximum(1, n))
    letters = np.zeros(256, dtype=bool)
    letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    np.cumsum(letters[words.raw], out=upto[1:])
    columns.append(add(upto[words.end] == upto[words.start]) / np.maximum(1, n))
    return np.repeat(np.arange(len(number)), number), np.stack(columns, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Weights as arrays; ``constant`` replaces them where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, bag: np.ndarray, figures: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((figures - self.mean) / self.scale, -8, 8)
        h = np.maximum(x @ w["encode"] + w["encode_b"], 0)
        tanh, gate = np.tanh(h @ w["tanh"] + w["tanh_b"]), _sigmoid(h @ w["gate"] + w["gate_b"])
        raw = (tanh * gate) @ w["attend"]
        start = np.searchsorted(bag, np.arange(bags))
        weight = np.exp(raw - np.maximum.reduceat(raw, start)[bag])
        weight /= np.add.reduceat(weight, start)[bag]
        z = np.add.reduceat(weight[:, None] * h, start, axis=0)
        return {"x": x, "h": h, "tanh": tanh, "gate": gate, "weight": weight, "z": z,
                "start": start, "logit": z @ w["out"] + w["out_b"]}

    def score(self, bag: np.ndarray, figures: np.ndarray, bags: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(bags, self.constant)
        return _sigmoid(self.forward(bag, figures, bags)["logit"])

    def gradients(self, bag: np.ndarray, figures: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(bag, figures, len(target))
        d_logit = (_sigmoid(f["logit"]) - target) / len(target)
        d_z = np.outer(d_logit, w["out"])
        d_weight = np.einsum("ij,ij->i", d_z[bag], f["h"])
        mean = np.add.reduceat(f["weight"] * d_weight, f["start"])
        d_raw = f["weight"] * (d_weight - mean[bag])
        d_both = np.outer(d_raw, w["attend"])
        d_tanh = d_both * f["gate"] * (1 - f["tanh"] ** 2)
        d_gate = d_both * f["tanh"] * f["gate"] * (1 - f["gate"])
        d_h = f["weight"][:, None] * d_z[bag] + d_tanh @ w["tanh"].T + d_gate @ w["gate"].T
        d_h *= f["h"] > 0
        return {
            "encode": f["x"].T @ d_h, "encode_b": d_h.sum(0),
            "tanh": f["h"].T @ d_tanh, "tanh_b": d_tanh.sum(0),
            "gate": f["h"].T @ d_gate, "gate_b": d_gate.sum(0),
            "attend": (f["tanh"] * f["gate"]).T @ d_raw,
            "out": f["z"].T @ d_logit, "out_b": d_logit.sum(keepdims=True)}


def train(
    bag: np.ndarray, figures: np.ndarray, target: np.ndarray, hidden: int = 24, attention: int = 12,
    epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11,
) -> AttentionModel:
    """Fit by Adam on bags numbered 0 to n - 1, ``bag`` ascending."""
    bags = len(target)
    if not bags or target.min() == target.max():
        return AttentionModel(np.zeros(0), np.ones(0), {}, float(target.mean()) if bags else 0.5)
    rng, d = np.random.default_rng(seed), figures.shape[1]
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = AttentionModel(figures.mean(0), figures.std(0) + 1e-3, {
        "encode": normal(d, hidden), "encode_b": np.zeros(hidden),
        "tanh": normal(hidden, attention), "tanh_b": np.zeros(attention),
        "gate": normal(hidden, attention), "gate_b": np.zeros(attention),
        "attend": normal(attention), "out": normal(hidden), "out_b": np.zeros(1)})
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    start = np.searchsorted(bag, np.arange(bags + 1))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(bags)
        pace = rate * (1 - epoch / epochs)
        for at in range(0, bags, batch):
            chosen = np.sort(order[at : at + batch])
            rows = np.concatenate([np.arange(start[b], start[b + 1]) for b in chosen])
            inner = np.repeat(np.arange(len(chosen)), start[chosen + 1] - start[chosen])
            step += 1
            for k, g in model.gradients(inner, figures[rows], target[chosen]).items():
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - pace * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", max_rows: int = 4000, max_passages: int = 200_000,
) -> AttentionModel:
    """Learn from the labels of rows that are ``usable`` (a condition on the id column)."""
    bound_batches(docs.sparkSession)
    known = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("doc_id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("double").alias("target"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sample = checkpoint(known.orderBy(order, "doc_id").limit(max_rows))
    # At most ``max_rows`` rows on the broadcast side.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column("text")):
                bag, figures = passage_figures(part)
                count = np.bincount(bag, minlength=len(part))
                edges = np.concatenate(([0], np.cumsum(count)))
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id").cast(pa.int64()), "target": rows.column("target"),
                    "passages": pa.array(count, pa.int64()),
                    "figures": pa.ListArray.from_arrays(
                        pa.array(edges * figures.shape[1], pa.int32()), pa.array(figures.ravel())),
                })

    encoded = checkpoint(texts.mapInArrow(
        lean(encode), "doc_id long, target double, passages long, figures array<double>"))
    sizes = encoded.groupBy("doc_id").agg(F.sum("passages").alias("passages")).collect()
    total, chosen = 0, []
    for row in sorted(sizes, key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"])):
        if row["passages"] > max_passages:
            continue
        total += row["passages"]
        if total > max_passages:
            break
        chosen.append(row["doc_id"])
    rows = encoded.filter(F.col("doc_id").isin(chosen)).collect() if len(chosen) < len(sizes) else encoded.collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["passages"], r["figures"]))
    width = len(FIGURES)
    figures = [np.array(r["figures"]).reshape(-1, width) for r in rows]
    bag = np.repeat(np.arange(len(rows)), [len(f) for f in figures])
    return train(
        bag, np.concatenate(figures) if figures else np.zeros((0, width)),
        np.array([r["target"] for r in rows]))


def _scores(model: AttentionModel, texts: pa.Array) -> np.ndarray:
    found = np.zeros(len(texts))
    for first, part in text_slices(texts):
        bag, figures = passage_figures(part)
        found[first : first + len(part)] = model.score(bag, figures, len(part))
    return found


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": pa.array(_scores(model, batch.column("text")))})

    return rows.mapInArrow(lean(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: AttentionModel, least: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored below ``least``."""
    bound_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(place)) >= least))

    return docs.mapInArrow(lean(run), docs.schema)
