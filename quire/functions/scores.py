"""Scores, counters and flags of a page text as native expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import chars_of, count_of, let, matches, strip, text_lines

_LATIN_WORD = rf"[{P.LATIN}]{{2,}}"
_LETTER_WORD = r"\p{L}{2,}"


#: literals (lower case) of which each alternative of the pattern holds one; a text without any needs no search
_AD_LITERALS = (
    "advert sponsored circle coupon % percent discount call order buy limited special subscribe toll 800 save free "
    "supplies now offer price money cashier enclosed ship reader www. $"
).split()
_SHOUT_LITERALS = ["unbelievable", "incredible", "amazing", "introducing", "new!", "$"]
_FORM_LITERALS = "enclosed cashier money personal ship circle reader bingo".split()


def _by_first_letter(words: str) -> str:
    """The same alternation with alternatives grouped by their first character, in the same order within each."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(words + "|"):
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0:
            parts.append(words[start:i])
            start = i + 1
    groups: dict[str, list[str]] = {}
    for part in parts:
        groups.setdefault(part[0], []).append(part[1:])
    inner = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())
    return rf"(?=[{''.join(groups)}])\b(?:{inner})\b"


def ad_cue_pattern(profile: str = "page") -> str:
    words = P.AD_WORDS if profile == "page" else P.AD_WORDS_WEB
    return rf"(?i)(?:\b(?:{words})\b|www\.|\$)"


def _ad_cues(profile: str = "page") -> str:
    """The matches of ``ad_cue_pattern``, which the SQL twins read, found with fewer tries."""
    words = P.AD_WORDS if profile == "page" else P.AD_WORDS_WEB
    return rf"(?i)(?:{_by_first_letter(words)}|www\.|\$)"


def _unless_absent(low: Column, literals: list[str], absent, search: Column) -> Column:  # type: ignore[no-untyped-def]
    """``search``, or ``absent`` where the lower-case text holds none of the literals; null texts are searched."""
    held = reduce(or_, [F.contains(low, F.lit(w)) for w in literals])
    return F.when(~held, absent).otherwise(search)


def prose_parts(text: str) -> dict[str, Column]:
    """Counters behind the prose score, each one pass over the text."""
    c = F.col(text)
    return {
        "alpha_words": count_of(c, _LATIN_WORD),
        "alpha_chars": F.length(c) - F.length(F.regexp_replace(c, F.lit(_LATIN_WORD), F.lit(""))),
        "sentence_ends": chars_of(c, r"[.!?…]"),
        # the look-ahead fails at once where no capital stands, before anything is looked up behind
        "caps3": count_of(c, rf"(?=[{P.LATIN_UPPER}]{{3}})(?<![{P.LATIN}])[{P.LATIN_UPPER}]{{3,}}(?![{P.LATIN}])"),
        "caps2": count_of(c, rf"(?=[{P.LATIN_UPPER}]{{2}})(?<![{P.LATIN}])[{P.LATIN_UPPER}]{{2,}}(?![{P.LATIN}])"),
    }


def prose_score() -> Column:
    """0..1 score from the counters of ``prose_parts``: higher means more like article prose."""
    n = F.col("alpha_words")
    score = (
        F.least(F.lit(0.4), n / 80.0)
        + F.least(F.lit(0.3), F.greatest(F.lit(1), F.col("sentence_ends")) / 6.0)
        + F.when(F.col("alpha_chars") / n >= 4.2, 0.2).otherwise(0.0)
        - F.least(F.lit(0.4), F.col("caps3") / n * 0.8)
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def with_text_features(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add the counters, cue lists and scores every classifier below reads. One projection, no shuffle."""
    c = F.col(text)
    trimmed_lines = F.filter(F.transform(text_lines(c), strip), lambda s: s != F.lit(""))
    low = F.col("_low")
    no_cues = F.array().cast("array<int>")
    counted = pages.withColumn("_low", F.lower(c)).withColumns(
        {
            **prose_parts(text),
            "continued_on": _unless_absent(low, ["cont"], no_cues, cue_numbers(text, P.CONTINUED_ON)),
            "continued_from": _unless_absent(low, ["cont"], no_cues, cue_numbers(text, P.CONTINUED_FROM)),
            "chars": F.length(strip(c)),
            "text_len": F.length(c),
            "words": count_of(c, r"\S+"),
            "caps_words": count_of(c, r"(?![\p{Ll}\s])(?<!\S)(?=\S*\p{Lu})(?!\S*\p{Ll})\S{3,}"),
            "cue_hits": _unless_absent(low, _AD_LITERALS, 0, count_of(c, _ad_cues())),
            "cue_hits_web": _unless_absent(low, _AD_LITERALS, 0, count_of(c, _ad_cues("web"))),
            "bangs": _unless_absent(low, ["!"], 0, chars_of(c, "!")),
            "bang_run": F.contains(c, F.lit("!!!")),
            "shout": _unless_absent(low, _SHOUT_LITERALS, False, matches(c, P.SHOUT)),
            "shout_web": _unless_absent(low, _SHOUT_LITERALS, False, matches(c, P.SHOUT_WEB)),
            "underscores": _unless_absent(low, ["__"], 0, count_of(c, "_{2,}")),
            "form_phrase": _unless_absent(low, _FORM_LITERALS, False, matches(c, P.FORM_AD)),
            "n_text_lines": F.size(trimmed_lines),
        }
    ).drop("_low")
    per_word = lambda hits: F.when(F.col("words") == 0, 0.0).otherwise(F.col(hits) / F.col("words"))
    return counted.withColumns(
        {
            "prose": prose_score(),
            "density": per_word("cue_hits"),
            "density_web": per_word("cue_hits_web"),
            "caps_ratio": F.col("caps2") / F.greatest(F.lit(1), F.col("alpha_words")),
        }
    )


def cue_numbers(text: str, pattern: str) -> Column:
    """Distinct page numbers of one cue kind in order of appearance."""
    # what both words for "continued" begin with is searched as one literal
    pattern = pattern.replace(r"(?:continued|cont(?:'?d|d)?\.?)", r"cont(?:inued|(?:'?d|d)?\.?)")
    return F.array_distinct(
        F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda s: s.cast("int"))
    )


def form_ad() -> Column:
    """Order form, subscription or reply card page."""
    return (F.size("continued_from") == 0) & (
        (F.col("underscores") >= 3)
        | ((F.col("underscores") >= 1) & F.col("form_phrase"))
        | (F.col("form_phrase") & (F.col("prose") < 0.55))
    )


def _protected() -> Column:
    """Pages that are never ads: landing pages and long articles that jump onwards."""
    return (F.size("continued_from") > 0) | (
        (F.size("continued_on") > 0) & (F.col("text_len") > 250) & (F.col("prose") >= 0.35)
    )


def ad_rules() -> list[tuple[str, Column]]:
    """Ordered ad signals of the page profile; the first that holds decides."""
    chars, prose, words = F.col("chars"), F.col("prose"), F.col("words")
    hits, caps = F.col("cue_hits"), F.col("caps_words")
    lines = F.col("n_text_lines")
    return [
        ("bangs", F.col("bang_run") | (F.col("bangs") >= 4)),
        ("shout", F.col("shout")),
        ("caps", (words < 80) & (F.col("alpha_words") > 0) & (F.col("caps_ratio") >= 0.25)),
        ("cues", hits >= 2),
        ("cue_short", (hits >= 1) & (chars < 450) & (prose < 0.45)),
        ("density", (F.col("density") >= 0.05) & (words >= 12)),
        ("fragments", (lines >= 6) & (prose < 0.45) & (words / lines <= 3.5)),
        ("tiny", (chars < 90) & (prose < 0.25)),
        ("short_caps", (chars < 220) & (caps >= 6) & (prose < 0.3)),
        ("short_cue", (chars < 160) & (hits >= 1)),
        ("sparse", (chars < 280) & (prose < 0.28) & (words < 45)),
        ("sparse_caps", (chars < 350) & (prose < 0.22) & (caps >= 4)),
        ("form", form_ad()),
    ]


def ad_rule() -> Column:
    """Name of the first ad rule that holds, null for pages that are not ads."""
    chain = F.when(_protected(), F.lit(None).cast("string"))
    for name, condition in ad_rules():
        chain = chain.when(condition, F.lit(name))
    return chain


def ad_reasons() -> Column:
    """All reasons of the web profile; covers are exempt."""
    words = F.col("words")
    hits = F.col("cue_hits_web")
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("bang_run") | (F.col("bangs") >= 4),
                F.lit("Multiple exclamation marks (shouty promotional style)"),
            ),
            F.when(F.col("shout_web"), F.lit("Promotional shout keywords (introducing, only $, etc.)")),
            F.when(
                (words < 80) & (F.col("alpha_words") > 0) & (F.col("caps_ratio") >= 0.25),
                F.lit("High proportion of all-caps advertising text"),
            ),
            F.when(
                hits >= 2,
                F.concat(F.lit("Multiple commercial/ad cue keywords ("), hits.cast("string"), F.lit(" hits)")),
            ),
            F.when(
                (hits >= 1) & (F.col("chars") < 450) & (F.col("prose") < 0.45),
                F.lit("Short text with ad cue and low prose score"),
            ),
            F.when((F.col("density_web") >= 0.05) & (words >= 12), F.lit("High density of advertising words (>=5%)")),
            F.when(form_ad(), F.lit("Order form or subscription fill-in coupon layout")),
        )
    )
    cover = (F.col("page_no") == 1) | (F.lower("label").contains("cover"))
    return F.when(cover | _protected(), F.array().cast("array<string>")).otherwise(reasons)


def article_body() -> Column:
    """Enough prose to be part of an article; reads ``is_ad``."""
    return ~F.col("is_ad") & (
        (F.size("continued_from") > 0) | ((F.col("chars") >= 120) & (F.col("prose") >= 0.35))
    )


def weak_page() -> Column:
    """Probably an insert even without an ad cue; reads ``is_ad``, ``is_body`` and ``skip_flag``."""
    no_from = F.size("continued_from") == 0
    low = ((F.col("chars") < 400) & (F.col("prose") < 0.35)) | ((F.col("chars") < 600) & (F.col("prose") < 0.28))
    return F.col("is_ad") | (~F.col("is_body") & no_from & (F.col("skip_flag") | low))


def word_score(word: Column) -> Column:
    """Readability score of one token: letters weigh most, marker glyphs and mixed tokens cost."""

    def scored(w: Column) -> Column:
        letters = chars_of(w, r"\p{L}")
        digits = chars_of(w, r"\p{Nd}")
        plain = chars_of(w, r"[ .,:;!?\-_/()\[\]'\"]")
        other = F.length(w) - letters - digits - plain
        # a plain word with at most one closing mark and no triple letter draws no penalty
        plain_word = matches(w, r"^(?!.*(.)\1{2})\p{L}+[.,;:!?]?$")
        closing = F.when(matches(w, r"[.,;:!?]$"), 0.7).otherwise(0.0)
        return F.when(w == "", F.lit(float("-inf"))).when(plain_word, F.length(w) * 1.5 - closing).otherwise(
            letters * 1.5
            + digits * 0.4
            + plain * 0.8
            - other * 2.0
            - F.when(matches(w, r"(.)\1{2,}"), 4.0).otherwise(0.0)
            - F.when(matches(w, r"[0-9][A-Za-z]|[A-Za-z][0-9]"), 2.0).otherwise(0.0)
            - F.when(matches(w, r"[§©®™_~|=]"), 6.0).otherwise(0.0)
            - F.when(letters / F.length(w) < 0.4, 3.0).otherwise(0.0)
        )

    return let(strip(word), scored)


def junk_text(text: Column) -> Column:
    """A line that is mostly garbage."""

    def judged(t: Column) -> Column:
        tokens = F.split(t, r"\s+")
        letters = chars_of(t, r"\p{L}")
        solid = chars_of(t, r"\S")
        bad = F.size(F.filter(tokens, lambda w: word_score(w) < 0))
        return (
            (t == "")
            | (letters == 0)
            | (letters / solid < 0.35)
            | (bad / F.size(tokens) > 0.65)
            | matches(t, r"[§©®™_=|~\[\]{}]")
        )

    def quick(t: Column) -> Column:
        # words of letters with at most one closing mark and no triple letter all score above 0
        plain = matches(t, r"^\p{L}++[.,;:!?]?(?:\s++\p{L}++[.,;:!?]?)*+$") & ~matches(t, r"(.)\1{2}")
        return F.when(plain, F.lit(False)).otherwise(judged(t))

    return F.coalesce(let(strip(text), quick), F.lit(True))
