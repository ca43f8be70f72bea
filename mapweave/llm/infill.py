"""Operator 12, fill-in-middle transformation.

A text is cut into units by a pattern, left to right, and two cut points that follow from the document's id divide it into prefix, middle
and suffix. The pieces are put together again in the order psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each behind its
mark; some documents stay plain. It is an Arrow-batched pandas UDF: the ends of all units lie in one compact array, so that a
cut is a lookup and a slice whatever the pattern is. Rows are handled one by one, so nothing is shuffled and a lost task is just run again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One code point, line ends too.
CODE_POINT = r"(?s)."
_RESULT = "n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
_END = type(regex.match("", "")).end


@dataclass(frozen=True)
class Marks:
    """What stands before the pieces. They must differ."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def within(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


def unit_ends(text: str, pattern: regex.Pattern) -> array:
    """0 and the end of each unit. What lies between two matches belongs to the later one, what follows the last match to the last."""
    ends = array("Q", (0,))
    ends.extend(map(_END, pattern.finditer(text)))
    if len(ends) > 1:
        ends[-1] = len(text)
    return ends


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32: the leading groups of the SHA-256 of `seed:key`."""
    digest = sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def restore(output: str, form: str, marks: Marks = Marks()) -> str:
    """The text that transform() made output from."""
    if form == "plain":
        return output
    first, second = (marks.prefix, marks.suffix) if form == "psm" else (marks.suffix, marks.prefix)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(marks.middle)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def rearranged(text: str, key: str, pattern: regex.Pattern, marks: Marks, seed: int, rate: int, spm: int) -> tuple:
    """A row of the result for one text."""
    ends = unit_ends(text, pattern)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, key)
    form, cuts, output, lengths = "plain", (None, None), text, (None, None)
    if text and not marks.within(text) and h3 % 100 < rate:
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = text[: ends[low]], text[ends[low] : ends[high]], text[ends[high] :]
        kind = "spm" if h4 % 100 < spm else "psm"
        pieces = (marks.suffix, suffix, marks.prefix, prefix) if kind == "spm" else (marks.prefix, prefix, marks.suffix, suffix)
        joined = "".join((*pieces, marks.middle, middle))
        if restore(joined, kind, marks) == text:  # marks that can arise where a piece and a mark meet would not come apart again
            form, cuts, output, lengths = kind, (low, high - low), joined, (len(prefix), len(middle))
    digest = lambda x: sha256(x.encode()).hexdigest()
    return n, form, *cuts, *lengths, output, digest(output), digest(restore(output, form, marks))


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = CODE_POINT,
    marks: Marks = Marks(),
    seed: int = 1,
    rate: int = 90,
    spm: int = 20,
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, prefix_chars, middle_chars, output, output_sha256, restored_sha256) for each row of docs.

    unit is a pattern of the regex library; n counts its matches. Of 100 documents about `rate` are rearranged, of these about `spm` in 100
    with the suffix first. Plain stay empty texts, texts that hold one of the marks, and texts that could not be rebuilt. A null text counts as
    empty, a null id as the empty key; repeated rows give repeated results. Extra columns, also ones named like the results, are ignored.
    """

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern, names = regex.compile(unit), [c.split()[0] for c in _RESULT.split(", ")]
        for keys, texts in batches:
            rows = [rearranged(text or "", key or "", pattern, marks, seed, rate, spm) for key, text in zip(keys, texts, strict=True)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in names if c.endswith(("units", "chars"))})

    made = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("__key"), F.col(text_col).cast("string").alias("__text"))
    return made.select("doc_id", run("__key", "__text").alias("made")).select("doc_id", "made.*")
