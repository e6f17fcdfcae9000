"""Small column helpers shared by all text jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P


def strip(c: Column) -> Column:
    """Trim all ASCII white space at both ends."""
    return F.trim(c, F.lit(P.WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(P.WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars_of(c: Column, cls: str) -> Column:
    """Number of characters of a class, by the length that is left without them; no array of matches is built."""
    return F.length(c) - F.length(F.regexp_replace(c, F.lit(f"{cls}+"), F.lit("")))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def replace_matches(c: Column, pattern: str, change: Callable[[Column], Column], needed: str | None = None) -> Column:
    """Replace each match by ``change(match)``; rows without a match are passed through untouched.

    ``needed`` is a cheap pattern that stands in every match.
    """

    def rebuilt(text: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.transform(
            F.arrays_zip(pieces.alias("p"), found.alias("m")),
            lambda e: F.concat(e["p"], F.coalesce(change(e["m"]), F.lit(""))),
        )
        return F.array_join(zipped, "")

    found = matches(c, pattern) if needed is None else matches(c, needed) & matches(c, pattern)
    return F.when(found, rebuilt(c)).otherwise(c)


def text_lines(c: Column) -> Column:
    return F.split(c, "\r?\n", -1)


def non_empty(arr: Column) -> Column:
    return F.filter(arr, lambda s: s != F.lit(""))


def paragraphs(c: Column) -> Column:
    """Trimmed non-empty parts between blank lines."""
    return non_empty(F.transform(F.split(c, r"\n\s*\n", -1), strip))
