"""Scalar text functions as built-in column expressions.

All whitespace handling follows Python's ``str.split()`` / ``strip()``
semantics with the ASCII class ``\\s`` (Spark's ``trim`` only strips spaces).
Each function notes its SQL spelling used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s+"

# Fixed values that must equal the reference for equal results:
# question words, checked in this order as substrings of the lower-cased text.
QUESTION_WORDS = ["what", "who", "where", "when", "why", "how", "which"]
# URL pattern removed from prompt text.
URL_PATTERN = r"https?://\S+|www\.\S+"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Python ``strip()``. SQL: ``regexp_replace(x, '^\\s+|\\s+$', '', 'g')``."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def words(c: str | Column) -> Column:
    """Python ``split()``; NULL stays NULL.
    SQL: ``list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '')``."""
    return F.array_remove(F.split(_c(c), WS), "")


def word_count(c: str | Column) -> Column:
    """whitespace word count, NULL -> 0."""
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("long")


def word_ngrams(c: str | Column, n: int) -> Column:
    """word n-grams joined by a space; empty when fewer than n words. They are the overlapping
    matches in the words' text, which takes half the time of slices of an array."""
    gram = r"(?<!\S)(?=(" + " ".join([r"\S++"] * n) + "))"
    found = F.regexp_extract_all(F.array_join(words(c), " "), F.lit(gram), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def truncate_words(c: str | Column, max_words: int = 3000) -> Column:
    """first ``max_words`` words re-joined by single spaces."""
    return F.array_join(F.slice(words(c), 1, max_words), " ")


def strip_urls(c: str | Column) -> Column:
    """remove ``http(s)://...`` and ``www....`` runs (whitespace-delimited)."""
    return F.regexp_replace(_c(c), URL_PATTERN, "")


def question_word(c: str | Column) -> Column:
    """first question word occurring as a substring of the lower-cased text."""
    low = F.lower(_c(c))
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in QUESTION_WORDS])


def dot_pieces(c: str | Column) -> Column:
    """every ``.`` splits; pieces are not trimmed; a trailing empty piece counts."""
    return F.split(_c(c), r"[.]")


def normalize(c: str | Column) -> Column:
    """Lower-case then strip whitespace."""
    return strip_ws(F.lower(_c(c)))


def before_bar(c: str | Column) -> Column:
    """Prediction text up to its first ``|``."""
    return F.substring_index(_c(c), "|", 1)


def normalize_prediction(c: str | Column) -> Column:
    return normalize(before_bar(c))


def contains_text(haystack: str | Column, needle: str | Column) -> Column:
    """substring inclusion; the empty string is contained in anything."""
    return F.contains(_c(haystack), _c(needle))
