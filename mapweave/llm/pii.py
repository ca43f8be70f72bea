"""Operator 7, personal data: regular expressions propose, checksums confirm, context words adjust the score.

DataFrame expressions only. The places of matches come from splitting the text at them: the lengths of the pieces and
of the matches add up to code-point offsets. Patterns use possessive repetition and start where a run of their
characters starts, so that they find the same matches as their plain forms without going back over long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern, characters without which nothing can match, check, score and context."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    score: float
    context: str = ""
    bonus: float = 0.0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    back = F.reverse(_digits(match))

    def add(total: Column, i: Column) -> Column:
        digit = back.substr(i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    length = F.length(_digits(match))
    return F.when(length.between(12, 19), F.aggregate(F.sequence(F.lit(1), length), F.lit(0), add) % 10 == 0).otherwise(False)


def _mod97(match: Column) -> Column:
    """The IBAN check: country and check digits to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    length = F.length(plain)
    return F.when(length.between(15, 34), F.aggregate(F.sequence(F.lit(1), length), F.lit(0), add) == 1).otherwise(False)


def _octets(match: Column) -> Column:
    small = lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255)
    return F.forall(F.split(match, "\\."), small)


def _phone_length(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


_MAILBOX = "[A-Za-z0-9._%+-]"
#: In the order in which spans with equal starts are listed; the first four are the base kinds.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_MAILBOX})){_MAILBOX}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", _octets, 0.6, r"\b(ip|host|server|address|adresse)\b", 0.3),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _luhn, 0.8, r"\b(card|visa|mastercard|credit|karte|carte|tarjeta)\b", 0.15),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone_length, 0.6, r"\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", 0.3),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", _mod97, 0.9, r"\b(iban|account|konto|compte|cuenta)\b", 0.1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: F.lit(True), 0.3, r"\b(ssn|social security|tax id)\b", 0.5),
)
BASE = ("email", "ip", "card", "phone")


def _spans_of(text: Column, code: int, kind: Kind, near: int) -> Column:
    none = F.array().cast(SPAN)
    parts = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda piece, match: F.struct(F.length(piece).alias("gap"), match.alias("match")),
    )

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        score = F.lit(kind.score)
        if kind.context:
            before = F.lower(text.substr(F.greatest(F.lit(1), start - (near - 1)), F.least(F.lit(near), start)))
            score = score + F.when(before.rlike(kind.context), kind.bonus).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(code).alias("kind"), end.alias("end"), score.alias("score"))
        found = F.when(part["match"].isNotNull() & kind.valid(part["match"]), F.array_append(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))
    found = F.aggregate(parts, begin, step, lambda acc: acc["found"])
    possible = text.rlike(kind.pattern)
    if kind.hint:
        possible = F.contains(text, F.lit(kind.hint)) & possible
    return F.when(possible, found).otherwise(none)


def find_spans(docs: DataFrame, min_score: float = 0.5, near: int = 40, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with one more column: its spans (start, kind, end, score) by start and then kind.

    Offsets are code points, end exclusive. A kind's matches are leftmost and don't overlap; those that fail
    its check are dropped without a retry. `near` code points before a span are searched for context words. A null
    text counts as empty. A column that is named `out` already is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*(_spans_of(text, i, kind, near) for i, kind in enumerate(KINDS))))
    return docs.withColumn(out, F.filter(spans, lambda s: s["score"] >= min_score))


def name_of(code: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), code + 1)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name_of(s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans of each row.

    A null or empty text has none: counts of 0, the hash of nothing and an empty list. Rows are judged one by one, repeated rows and rows with
    a null id like any other. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = find_spans(own).select("doc_id", "spans")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS[: len(BASE)])),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        *(count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if i >= len(BASE)),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; spans that overlap become one, the first kind's.

    Texts without spans, also null ones, stay as they are; other columns are passed on.
    """
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(name_of(s["kind"])), F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"),
        )

    spans = "__spans"
    rest = lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))
    masked = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return find_spans(docs, text_col=text_col, out=spans).withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).drop(spans)
