"""Predicates over a line of text: margins, dates, page numbers, tables, garbage, gibberish."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import chars_of, count_of, let, matches, non_empty, strip


def _has_digit(c: Column) -> Column:
    return matches(c, "[0-9]")


def artifact(c: Column) -> Column:
    return (_has_digit(c) | matches(c, "(?i)canvas")) & matches(c, P.BROWSER_ARTIFACT)


def url_or_artifact(c: Column) -> Column:
    """The cheap first test names characters every alternative of the long pattern needs."""
    possible = matches(c, r"(?i)[:/\\]|www\.|\.(?:pdf|htm|doc|txt|epub)")
    return (possible & matches(c, P.FILE_OR_URL)) | artifact(c)


def date_or_time(c: Column) -> Column:
    """Every date, issue and year pattern holds a digit."""
    return _has_digit(c) & (
        matches(c, P.DATE_OR_TIME) | matches(c, P.ISSUE_VOL) | ((F.length(c) <= 40) & matches(c, P.YEAR))
    )


def page_number(c: Column) -> Column:
    return (
        (_has_digit(c) & (matches(c, P.PAGE_NUMBER) | matches(c, P.PAGE_OF)))
        | matches(c, P.ROMAN_NUMBER)
        | artifact(c)
    )


def normal_header(c: Column) -> Column:
    """Form under which running heads are compared across pages."""
    return F.trim(F.regexp_replace(F.lower(c), F.lit(P.HEADER_PUNCT), F.lit(" ")))


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of three or more characters of a document name."""
    stem = F.regexp_replace(name, F.lit(r"(?i)\.(pdf|ocr\.txt|txt|png|jpg|jpeg|svg)$"), F.lit(""))
    plain = F.trim(F.regexp_replace(stem, F.lit(r"[_\-./\\|:]+"), F.lit(" ")))
    return F.array_distinct(F.filter(F.split(F.lower(plain), r"\s+"), lambda t: F.length(t) >= 3))


def has_token(c: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(F.lower(c), t))


def table_line(c: Column) -> Column:
    """Table divider, border rule or symbol grid; blank text counts as one."""

    def judged(t: Column) -> Column:
        symbols = chars_of(t, P.TABLE_SYMBOLS)
        patterns = reduce(lambda a, b: a | b, [matches(t, p) for p in P.TABLE_LINES])
        no_alnum = ~matches(t, r"[\p{L}0-9]")
        return (
            (t == "")
            | (no_alnum & (patterns | (F.length(t) >= 2)))
            | ((symbols >= 8) & (symbols / F.length(t) > 0.65))
        )

    return let(strip(c), judged)


def _whole_tokens(t: Column, pattern: str) -> Column:
    """Number of tokens that match; the pattern may match the empty string between tokens, which does not count."""
    return F.size(non_empty(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))


def garbage(c: Column, profile: str = "page") -> Column:
    """Scan noise rather than words. The page profile needs two of three signals; the web profile also drops tables."""

    word = r"\p{L}\p{N}_" if profile == "page" else "A-Za-z0-9_"
    inner = rf"[^{word}\s]*"
    # tokens of at most two word characters, whatever stands around and between them
    tiny = rf"(?<!\S){inner}(?:[{word}]{inner}){{0,2}}(?!\S)"
    if profile == "page":
        known = rf"(?i)(?<!\S)[.,;:!?\"'()]*(?:{'|'.join(P.COMMON_SHORT)})[.,;:!?\"'()]*(?!\S)"
    else:
        spelled = "|".join(inner.join(w) for w in P.COMMON_SHORT)
        known = rf"(?i)(?<!\S){inner}(?:{spelled}){inner}(?!\S)"

    def judged(t: Column) -> Column:
        few = F.greatest(F.lit(1), count_of(t, r"\S+")) * 0.45
        n_tiny = _whole_tokens(t, tiny)
        # the known words need not be looked for where there are too few tiny ones anyway
        signals = (
            F.when(n_tiny <= few, 0).otherwise((n_tiny - _whole_tokens(t, known) > few).cast("int"))
            + (count_of(t, rf"[{word}][\"'(),;:](?!\s|$)") >= 3).cast("int")
            + (chars_of(t, r"\p{L}") / F.length(t) < 0.35).cast("int")
        )
        noisy = matches(t, P.LONG_DASHES) | (signals >= 2)
        if profile == "page":
            return (F.length(t) >= 8) & noisy
        return (
            F.when(t == "", True)
            .when(table_line(t), True)
            .when(F.length(t) < 8, ~matches(t, r"[\p{L}0-9]"))
            .otherwise(noisy)
        )

    return let(strip(c), judged)


def junk_line(c: Column) -> Column:
    """Copyright, subscription and inquiry-card lines (C17)."""
    return let(
        strip(c),
        lambda t: (F.length(t) >= 3) & reduce(lambda a, b: a | b, [matches(t, p) for p in P.JUNK_LINES]),
    )


def gibberish_token(token: Column) -> Column:
    """Scan artefact instead of a word."""

    def judged(t: Column) -> Column:
        n = F.length(t)
        mixed = matches(t, r"\d") & matches(t, r"[A-Za-z]")
        return (
            F.when(t == "", False)
            .when(matches(t, r"^\d+(?:\.\d+)?$") | matches(t, P.SHORT_UNITS), False)
            .when(matches(t, r"(?i)^[bcdfghjklmnpqrstvwxyz]$"), True)
            .when((n == 2) & matches(t, r"^[A-Za-z]{2}$") & ~F.lower(t).isin(P.TWO_LETTER_WORDS), True)
            .when((n >= 4) & matches(t, r"[a-z]{2,}[A-Z]{2,}|[A-Z]{2,}[a-z]{2,}[A-Z]"), True)
            .when(mixed & matches(t, P.TECH_CODES), False)
            .when(mixed & matches(t, r"(?i)[a-z]\d[a-z]|\d[a-z]\d[a-z]"), True)
            .otherwise(
                (n >= 3) & ~matches(t, r"(?i)[aeiouy]") & matches(t, r"(?i)^[bcdfghjklmnpqrstvwxz]+$")
            )
        )

    edges = r"^[^\p{L}0-9]+|[^\p{L}0-9]+$"
    # an ordinary word, at most the first letter capital and with a vowel, fails every rule
    ordinary = matches(token, r"^(?=\p{L}*[aeiouyAEIOUY])\p{L}\p{Ll}{2,}[.,;:!?]?$")
    return ~ordinary & let(F.regexp_replace(token, F.lit(edges), F.lit("")), judged)


def gibberish_line(c: Column) -> Column:
    """A line with too many gibberish tokens."""

    def judged(tokens: Column) -> Column:
        bad = F.size(F.filter(tokens, gibberish_token))
        n = F.size(tokens)
        return (bad / n >= 0.28) | ((n >= 5) & (bad >= 3))

    stripped = strip(c)
    return F.when(stripped == "", False).otherwise(let(F.split(stripped, r"\s+"), judged))
