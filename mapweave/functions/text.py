"""Text functions: tokens, titles, categories, links and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that titles of lists and dates contain.
TITLE_WORDS = [
    "list", "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
STOP_WORDS = ["the", "and", "for", "that", "was", "are", "with", "this", "from", "der", "die", "das", "und", "les", "des", "que", "los", "las"]


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: F.length(t) > 0)


def content_tokens(text: Column | str, least: int = 3, stop: list[str] | None = None) -> Column:
    words = F.array(*(F.lit(w) for w in (STOP_WORDS if stop is None else stop)))
    return F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~F.array_contains(words, t))


def is_article_title(title: Column | str) -> Column:
    """Whether a title names an article: no year before a space, no number at its end, no category, list or month."""
    title = F.col(title) if isinstance(title, str) else title
    words = F.split(F.lower(title), r"\s+")
    return ~title.rlike("[0-9]{4} ") & ~title.rlike("[0-9]$") & ~title.contains("Category") & ~F.arrays_overlap(words, F.array(*(F.lit(w) for w in TITLE_WORDS)))


def category_name(category: Column | str) -> Column:
    """A category's plain name: cut before " by", or else without "Types of "; then without the prefix "Category:"."""
    category = F.col(category) if isinstance(category, str) else category
    at = F.instr(category, " by")
    plain = F.when(at > 0, F.substring(category, F.lit(1), at - 1)).otherwise(F.regexp_replace(category, "Types of ", ""))
    return F.regexp_replace(plain, "Category:", "")


def is_topic_category(category: Column | str) -> Column:
    category = F.col(category) if isinstance(category, str) else category
    return ~F.lower(category).contains("redirect") & ~F.lower(category).contains("disambiguation")


def display_name(name: Column | str) -> Column:
    """Lower-case, trimmed, words joined by underscores."""
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", "_")


def wiki_links(text: Column | str) -> Column:
    """Targets of [[target|label]] links from the first bold name on (the lead section)."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.instr(text, "'''")
    lead = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    return F.regexp_extract_all(lead, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def cleaned(text: Column | str) -> Column:
    """Without formulas, headings, parentheses and one-letter words."""
    for pattern in (r"\{\\[^}]*\}", r"(?m)^=+[^=]*=+\s*$", r"\(.+\)", r"\b\p{L}\b"):
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"^\s+|\s+$", "")


def sentences(text: Column | str) -> Column:
    """The sentences of a text: cut after a full stop, question or exclamation mark before white space, and at blank lines."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n\s*\n"), lambda x: F.length(F.trim(x)) > 0)


def word_tokens(text: Column | str, stop: list[str] | None = None) -> Column:
    """Words of more than one character that aren't on the list and look like neither a number nor an address, in order."""
    words = F.split(F.lower(text), r"[\s.,;:!?()\[\]{}\"']+(?=\s|$)|\s+[(\[{\"']*|^[(\[{\"']+")
    known = F.array(*(F.lit(w) for w in (STOP_WORDS if stop is None else stop)))
    number, address = r"^[+-]?[0-9][0-9.,/]*%?$", r"^(https?://|www\.)|^[^\s/]+\.(com|org|net|edu|gov|io|de|fr|es)(/|$)"
    return F.filter(words, lambda t: (F.length(t) > 1) & ~F.array_contains(known, t) & ~t.rlike(number) & ~t.rlike(address) & t.rlike(r"[\p{L}\p{N}]"))


def list_cell(cell: Column | str) -> Column:
    """A cell like "[1, 2]" as an array of whole numbers; null where it is no list."""
    return F.from_json(cell, "array<int>")


def two_words_a_line(text: Column | str) -> Column:
    """The words of a title in lines of two."""
    words = F.filter(F.split(F.col(text) if isinstance(text, str) else text, r"\s+"), lambda w: w != "")
    lines = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(2)), lambda i: F.array_join(F.slice(words, i, 2), " "))
    return F.when(F.size(words) > 0, F.array_join(lines, "\n")).otherwise("")


# English contractions and what they stand for.
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", "'re": " are", "'ll": " will", "'ve": " have", "'m": " am", "it's": "it is", "let's": "let us"}


def expanded(text: Column | str) -> Column:
    """Lower-case text with contractions written out (C20)."""
    text = F.lower(text)
    for short, long in CONTRACTIONS.items():
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def without_accents(text: Column | str) -> Column:
    """Letters without their accents, signs other than letters, digits and spaces removed (C20)."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFD").str.replace(r"[\u0300-\u036f]", "", regex=True)

    return F.regexp_replace(run(text), r"[^\p{L}\p{N}\s]", "")


def ngrams(words: Column | str, n: int) -> Column:
    """Adjacent n words joined by a space."""
    words = F.col(words) if isinstance(words, str) else words
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def joined_at(words: Column | str, places: Column | str) -> Column:
    """words with those at the places (from 1, ascending, two apart at least) joined by an underscore to the next (X1), in linear time."""
    words, places = (F.col(c) if isinstance(c, str) else c for c in (words, places))
    before = lambda k: F.coalesce(F.get(places, k - 1), F.lit(-1))
    part = lambda p, k: F.concat(F.slice(words, before(k) + 2, p - before(k) - 2), F.array(F.concat_ws("_", F.get(words, p - 1), F.get(words, p))))
    last = before(F.size(places))
    return F.concat(F.flatten(F.transform(places, part)), F.slice(words, last + 2, F.size(words) - last - 1))


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    kinds = "".join("v" if c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" else "c" for i, c in enumerate(stem))
    return kinds.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and i for i, c in enumerate(stem))


def _ends_cvc(stem: str) -> bool:
    vowel = lambda i: stem[i] in "aeiou" or stem[i] == "y" and i and stem[i - 1] not in "aeiou"
    n = len(stem)
    return n >= 3 and not vowel(n - 1) and vowel(n - 2) and not vowel(n - 3) and stem[-1] not in "wxy"


# Suffixes of the published Porter (1980) algorithm, by step.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(word: str) -> str:
    """Porter's stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = max((s for s in _STEP_4 if word.endswith(s)), key=len, default=None)
    if suffix and _measure(stem := word[: -len(suffix)]) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
        word = stem
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _ends_cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def lemma(word: str) -> str:
    """An approximate noun lemma: plural endings only."""
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ses", "xes", "zes", "ches", "shes")) and len(word) > 4:
        return word[:-2]
    if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3:
        return word[:-1]
    return word


def with_word_forms(labels: DataFrame, column: str = "label") -> DataFrame:
    """labels with `stem` and `lemma` of each distinct value of the column, word by word."""

    def form(rule):
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else " ".join(rule(w) for w in v.split()))

        return run

    forms = labels.select(column).distinct().withColumn("stem", form(porter_stem)(column)).withColumn("lemma", form(lemma)(column))
    return labels.join(forms, column, "left")
