"""Small hard cases, and plain versions of what the operators compute."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_at string, key long, size string, kept int, _text string")


def hard_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    base = " ".join(f"word{i % 37} Thing{i}" for i in range(60))
    texts = [
        None, "", "", " \t\n ", "one", "one two", "one two three", "ONE two three", base, base, base + " end",
        base.replace("Thing30", "other"), "x" * 5000, "long " * 4000, "a.b@c.de +1 (524) 555-7373 now",
        "card 4111 1111 1111 1111 and 10.0.0.255", "é ü ß " * 30, "line\nline\nother\nline", "tie", "tie", "tie",
    ]
    rows = [
        (i, t, [None, "en", "de"][i % 3], [None, "a", "b", "c"][i % 4], None, "x", i, "s", i % 2, "y")
        for i, t in enumerate(texts)]
    rows += [rows[18], (None, "tie", None, None, None, None, None, None, None, None), (None, None, "en", "a", 1, None, None, None, None, None)]
    return rows


def hard_docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def sf_docs(spark, sf: str = "sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
