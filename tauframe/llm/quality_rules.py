"""Quality rules with thresholds learned per language and source.

Each text gets counts of words, characters, symbols, repeated lines and repeated
five-word windows. Ratios of these are summarised by a quantile sketch for each
(language, source): counts over logarithmic bins, whose relative error is bounded and
which merge by addition, so partial sketches are added before and after the shuffle
and the sketches of a language's sources add up to that of the language.

A group's bounds come from its sketch alone: the median plus ``width`` times the distance
from there to the quantile ``tail``, and for word length also the same downwards. Quantiles
of a group are drawn towards those of its language with the weight of ``prior`` documents,
so a small source has no thresholds of its own making. No ratio has a fixed cutoff or a
least spread: a text passes while its count is at most what a count with the bound as its rate
reaches by chance, ``chance`` standard deviations above it (for rate 0: ``chance`` squared).

Choices: a null text has no words and fails; a null language or source is a group
like any other. Repeated rows count each. An empty table gives no rows. Columns other
than id, text, language and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.llm.storage import bound_batches, checkpoint
from tauframe.llm.textvec import mix, text_slices, windows, words_of

#: Ratio -> (numerator, denominator, whether low values fail too).
RATIOS: dict[str, tuple[str, str, bool]] = {
    "word_length": ("word_chars", "n_words", True),
    "symbol_share": ("n_symbols", "word_chars", False),
    "upper_share": ("n_upper", "word_chars", False),
    "duplicate_lines": ("n_dup_lines", "n_lines", False),
    "repeated_words": ("n_repeat_words", "n_words", False),
}
#: Bins grow by this factor; values below ``TINY`` share one bin.
GROWTH, TINY = 1.02, 1e-4

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return upto[offsets[1:]] - upto[offsets[:-1]]


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The ``COUNTS`` of each text of an array without nulls."""
    words = words_of(texts, lower=False)
    raw, offsets, n = words.raw, words.offsets, len(texts)
    hashes = words.hashes()
    solid = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(solid, words.start, 1)
    np.add.at(solid, words.end, -1)
    in_word = np.cumsum(solid[:-1], dtype=np.int8) > 0
    whole_char = (raw & 0xC0) != 0x80

    breaks = np.flatnonzero(raw == 10)
    first = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    first = first[first < len(raw)]
    last = np.append(first[1:], len(raw))[: len(first)]
    last = last - ((last > first) & (raw[last - 1] == 10))
    doc = np.searchsorted(offsets, first, "right") - 1
    has_word = np.searchsorted(words.start, last) > np.searchsorted(words.start, first)
    first, last, doc = first[has_word], last[has_word], doc[has_word]
    lines = np.bincount(doc, minlength=n)
    key = np.unique(np.stack((doc.astype(np.uint64), words.span_hash(first, last)), 1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
    distinct = np.bincount(key[:, 0].astype(np.int64), minlength=n)

    at, window = windows(hashes, words.doc, 5)
    keyed = mix(window ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.start) + 1, dtype=np.int32)
    edge[at[twice]] += 1
    np.subtract.at(edge, at[twice] + 5, 1)
    covered = np.cumsum(edge[:-1]) > 0
    repeated = np.bincount(words.doc[covered], minlength=n)
    upper = (raw >= 65) & (raw <= 90)
    return [
        words.count, _per_text(in_word & whole_char, offsets), _per_text(_SYMBOL[raw], offsets),
        lines - distinct, repeated, _per_text(upper, offsets), lines,
    ]


def rule_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc_id, lang, source and ``COUNTS`` of every row."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "lang", "source"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                columns = [pa.array(c, pa.int64()) for c in text_counts(texts)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), *columns], names=[*names, *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(count, schema)


def _ratio(name: str) -> Column:
    above, below, _ = RATIOS[name]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n): the sketch of each group and ratio."""
    bins = [
        F.struct(F.lit(name).alias("ratio"), F.when(_ratio(name) >= TINY, F.ceil(
            F.log(_ratio(name)) / float(np.log(GROWTH)))).otherwise(F.lit(-(1 << 20))).cast("int").alias("bin"))
        for name in RATIOS]
    return counts.select("lang", "source", F.explode(F.array(*bins)).alias("x")).groupBy(
        "lang", "source", F.col("x.ratio").alias("ratio"), F.col("x.bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], tail: float) -> DataFrame:
    """(keys, ratio, docs, low, mid, high) from merged sketches: the quantiles 1 - ``tail``, 0.5
    and ``tail``; the middle of a bin stands for it."""
    merged = sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    upto = F.sum("n").over(group.orderBy("bin"))
    ranked = merged.withColumn("upto", upto).withColumn("docs", F.sum("n").over(group))
    value = F.when(F.col("bin") > -(1 << 20), F.pow(F.lit(GROWTH), F.col("bin") - 0.5)).otherwise(F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("docs") * q, value))
    return ranked.groupBy(*keys, "ratio").agg(
        F.max("docs").alias("docs"), at(1 - tail).alias("low"), at(0.5).alias("mid"), at(tail).alias("high"))


def thresholds(counts: DataFrame, tail: float, width: float, prior: int) -> DataFrame:
    """(lang, source, <ratio>_least, <ratio>_most): one row for each group."""
    sketch = checkpoint(sketches(counts))
    own = quantiles(sketch, ["lang", "source"], tail)
    wide = quantiles(sketch, ["lang"], tail).select(
        F.col("lang").alias("_lang"), F.col("ratio").alias("_ratio"),
        *[F.col(c).alias(f"_{c}") for c in ("low", "mid", "high")])
    both = own.join(wide, own["lang"].eqNullSafe(wide["_lang"]) & (own["ratio"] == wide["_ratio"]))
    low, mid, high = (
        (F.col(c) * F.col("docs") + F.col(f"_{c}") * prior) / (F.col("docs") + prior) for c in ("low", "mid", "high"))
    bounds = []
    for name in RATIOS:
        mine = F.col("ratio") == name
        bounds += [
            F.max(F.when(mine, F.greatest(mid - (mid - low) * width, F.lit(0.0)))).alias(f"{name}_least"),
            F.max(F.when(mine, mid + (high - mid) * width)).alias(f"{name}_most")]
    return both.groupBy("lang", "source").agg(*bounds)


def _passes(name: str, chance: float) -> Column:
    above, below, two_sided = RATIOS[name]
    most, least = F.col(f"{name}_most") * F.col(below), F.col(f"{name}_least") * F.col(below)
    inside = F.col(above) <= most + chance * F.sqrt(most + chance**2 / 4) + chance**2 / 2
    return inside & (F.col(above) >= least - chance * F.sqrt(least)) if two_sided else inside


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tail: float = 0.9,
    width: float = 3.0,
    prior: int = 100,
    chance: float = 3.0,
) -> DataFrame:
    """doc_id, lang, source, ``COUNTS``, base_failed, kept of every row."""
    counts = checkpoint(rule_counts(docs, id_col, text_col, lang_col, source_col))
    limits = thresholds(counts, tail, width, prior).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passes = F.lit(True)
    for name in RATIOS:
        passes = passes & _passes(name, chance)
    joined = counts.join(
        limits, counts["lang"].eqNullSafe(limits["_lang"]) & counts["source"].eqNullSafe(limits["_source"]))
    return joined.select(
        "doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"), (~failed & passes).alias("kept"))
