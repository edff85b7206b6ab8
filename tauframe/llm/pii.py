"""Personal data: patterns propose spans, checks confirm them, context adjusts the score.

Everything is a column expression, so the scan is one narrow stage without a shuffle.
Spans come from splitting the text by a kind's pattern: the lengths of the pieces and of
the matches give the code points where each match lies, and the pieces beside a match are
its context.

Each pattern matches from the left without overlaps. Runs are possessive and starts are
anchored at the beginning of a run, which leaves the matches as they are and keeps long
runs linear; places come from running sums, n log n for n matches of a text; numbers too short or too long for a card are passed over as a whole.

A span's score is the prior of its kind plus ``CONTEXT_GAIN`` if a word of its kind stands
within ``CONTEXT`` characters; spans of at least ``least`` are returned. The priors of email,
ip, card and phone are above it, so context ranks but never removes them; a national number
without checksum counts only with its context. A null text is empty; repeated rows are
scanned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 48
CONTEXT_GAIN = 0.3

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        value = F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(value > 9, value - 9).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code, first four characters moved to the end, is 1 modulo 97."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        value = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``needs`` is a string that every match contains, or none."""

    name: str
    pattern: str
    confirm: object
    prior: float
    context: str
    needs: str | None = None
    base: bool = True


KINDS = [
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), 0.7, "e-?mail|contact|kontakt|correo|courriel|write to", "@"),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda m: m.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"), 0.6, r"\bip\b|address|host|server|login", "."),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
        lambda m: luhn(_digits(m)), 0.65, "card|visa|credit|debit|karte|tarjeta|carte"),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|tel|call|mobile|fax|anruf|llam", "+"),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
        mod97, 0.6, "iban|account|konto|cuenta|compte|bank", base=False),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda m: ~m.rlike(r"\A(?:000|666|9)|-00-|-0000\z"), 0.3, r"\bssn\b|social security", "-", base=False),
]

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of an array's integers up to each place: as many passes as its size has bits,
    each adding what stands 1, 2, 4, ... places before."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def add(sums: Column, bit: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), bit)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    return F.aggregate(passes, values, add)


def _spans(kind: Kind, text: Column, found: Column, least: float) -> Column:
    """Confirmed spans of one kind, from the left."""
    whole = F.struct(found.alias("found"), F.split(text, kind.pattern, -1).alias("pieces"))

    def located(parts: Column) -> Column:
        found, pieces = parts["found"], parts["pieces"]

        def listed(ends: Column) -> Column:
            def span(match: Column, i: Column) -> Column:
                near = F.concat(
                    F.right(F.get(pieces, i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)))
                gain = F.when(F.lower(near).rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
                end = F.get(ends, i)
                return F.struct(
                    F.lit(kind.name).alias("kind"), (end - F.length(match)).alias("start"), end.alias("end"),
                    (F.lit(kind.prior) + gain).alias("score"), kind.confirm(match).alias("passes"))

            sure = F.filter(F.transform(found, span), lambda s: s["passes"] & (s["score"] >= least))
            return F.transform(sure, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "score")]))

        return _bind(running_sums(F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))), listed)

    return F.when(F.size(found) > 0, _bind(whole, located).cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id and, for each kind, its spans (kind, start, end, score) from the left."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        found = F.regexp_extract_all(F.col("_text"), F.lit(kind.pattern), F.lit(0))
        if kind.needs:
            found = F.when(F.contains(F.col("_text"), F.lit(kind.needs)), found).otherwise(none)
        rows = rows.withColumn(f"_{kind.name}", found)
    return rows.select("doc_id", *[
        _spans(kind, F.col("_text"), F.col(f"_{kind.name}"), least).alias(kind.name) for kind in KINDS])


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
