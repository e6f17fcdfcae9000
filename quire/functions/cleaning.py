"""Column expressions of the cleaning rules.

Rules that share one replacement shape are merged into one alternation where the output of one cannot feed another; the
rest is chained. ``page`` profiles use Unicode word boundaries, ``web`` profiles ASCII ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import let, matches, non_empty, replace_matches, strip, sub

_ASCII_START = r"(?<![A-Za-z0-9_])"
_ASCII_END = r"(?![A-Za-z0-9_])"
# An ASCII word boundary in either direction.
_ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_LOWER = "[a-zà-öø-ÿ]"
_CONNECT = rf"(?i:{'|'.join(P.CONNECTORS)})"


def _edges(profile: str) -> tuple[str, str, str]:
    """Word start, word end and word-character class of a profile."""
    if profile == "web":
        return _ASCII_START, _ASCII_END, r"\p{L}0-9"
    return P.WB, P.WE, P.W


def _opening(words) -> str:  # type: ignore[no-untyped-def]
    """Look-ahead for the first letters of ``words``, cheaper than the look-behind it is put before; empty if one has none."""
    letters = {w[:1].lower() for each in words for w in each.split("|")}
    plain = all(re.fullmatch(r"[A-Za-z]+(?:\|[A-Za-z]+)*", w) for w in words)
    return f"(?=[{''.join(sorted(letters))}])" if plain else ""


# --- hyphens (C02) -----------------------------------------------------------------------------------------------------


def dehyphenate(c: Column, profile: str = "page") -> Column:
    """Join words split by a hyphen and blanks before a lower-case letter; connectors keep the hyphen.

    The look-arounds consume nothing but hyphen and blanks, so one pass reaches the fixed point. The look-behind comes after the
    hyphen, so it is tried only there.
    """
    word = _edges(profile)[2]
    t = F.replace(c, F.lit("­"), F.lit("-" if profile == "page" else ""))
    t = sub(t, rf"-(?<=[{word}]-)\s+(?={_LOWER})(?!{_CONNECT}(?![{word}]))", "")
    return sub(t, rf"-(?<=[{word}]-)\s+(?={_LOWER})", "-")


# --- split words (C03, C04) ----------------------------------------------------------------------------------------------


def _spaced_hyphens(c: Column, profile: str) -> Column:
    word = _edges(profile)[2]
    gap = r"\s+" if profile == "web" else r"\s*"
    pattern = rf"[{word}]{{2,}}{gap}[\-‐–]\s+{_LOWER}[{word}]*"
    hyphen = r"\s*[\-‐–]\s+"
    return replace_matches(
        c,
        pattern,
        lambda m: F.when(matches(m, rf"[\-‐–]\s+{_CONNECT}$"), sub(m, hyphen, "-")).otherwise(
            sub(m, hyphen, "")
        ),
        rf"[\-‐–]\s+{_LOWER}",
    )


def _families(c: Column, profile: str) -> Column:
    """Detached prefixes, suffixes, domain words and single letters."""
    start, end, word = _edges(profile)
    close = _ASCII_EDGE if profile == "web" else ""
    t = sub(c, rf"(?iu){start}({'|'.join(P.PREFIXES)})\s+({_LOWER}[{word}]*){close}", "$1$2")
    t = sub(t, rf"(?iu){start}({_LOWER}{{3,}})\s+({'|'.join(P.SUFFIXES)}){end}", "$1$2")
    domain = "|".join(rf"({a})\s+({b})" for a, b in P.SPLIT_WORDS)
    groups = "".join(f"${i}" for i in range(1, 2 * len(P.SPLIT_WORDS) + 1))
    t = sub(t, rf"(?i){_opening([a for a, _ in P.SPLIT_WORDS])}{start}(?:{domain}){end}", groups)
    first, *others = P.BROKEN_LETTERS
    t = sub(t, rf"(?i){_opening([first[0]])}{start}({first[0]})\s+({first[1]}){end}", "$1$2")
    tails = "|".join(rf"({a})\s+({b})" for a, b in others)
    return sub(t, rf"(?i){_opening([a for a, _ in others])}{start}(?:{tails}){end}", "$1$2$3$4$5$6")


def core_repair_steps(profile: str = "page") -> list:
    """C03 as ordered steps; each reads the column the step before wrote."""
    return [
        lambda c: sub(c, "[­​]", ""),
        lambda c: _spaced_hyphens(c, profile),
        lambda c: _families(c, profile),
    ]


def _fixed_typos(c: Column) -> Column:
    t = sub(c, rf"(?i){_ASCII_START}lin\s*e\s*of{_ASCII_END}", "line of")
    t = sub(t, rf"(?i){_ASCII_START}lin\s+e{_ASCII_END}", "line")
    ends_in_c = rf"(?i){_ASCII_START}(?:{'|'.join(P.FINAL_C)}){_ASCII_END}"
    return replace_matches(t, ends_in_c, lambda m: F.concat(F.substr(m, F.lit(1), F.length(m) - 1), F.lit("e")))


def _syllables(c: Column) -> Column:
    experiment = "|".join(P.EXPERIMENTATION)
    known = "|".join(s.replace(" ", r"\s+") for s in sorted(P.SYLLABLES, key=len, reverse=True))
    broken = r"ex\s+pc\s+rimc\s+nt"
    return replace_matches(
        c,
        rf"(?i){_ASCII_START}(?:{experiment}|{broken}|{known}){_ASCII_END}",
        lambda m: F.when(matches(m, rf"(?i)^(?:{experiment})$"), "experimentation")
        .when(matches(m, rf"(?i)^{broken}$"), "experiment")
        .otherwise(F.lower(sub(m, r"\s+", ""))),
    )


_RUN_END = r"(?=\s|[.,;:!?]|\z)"


def _run(token: str) -> str:
    """Three or more tokens and what is in front of them; only the last one may have a mark behind it.

    Possessive: a run of any length is matched without a stack frame per token. An overflow there ends the whole executor.
    """
    return rf"(?:^|\s){token}(?:\s+{token}{_RUN_END}){{2,}}+"


def _lead(m: Column) -> Column:
    """A glued run keeps a blank in front of it; another white-space character is lost."""
    return F.when(F.startswith(m, F.lit(" ")), " ").otherwise("")


def merge_syllables(c: Column) -> Column:
    """Glue a run of three or more tokens of one to three letters unless one of them is a real short word."""

    def glue(m: Column) -> Column:
        tokens = F.split(strip(m), r"\s+")
        known = F.exists(tokens, lambda w: F.lower(w).isin(P.STANDALONE_SHORT))
        joined = F.array_join(tokens, "")
        return F.when(known | (F.length(joined) < 4), m).otherwise(F.concat(_lead(m), joined))

    return replace_matches(c, _run("[a-zA-Z]{1,3}"), glue)


def spaced_letters(c: Column) -> Column:
    """Glue three or more single letters."""
    return replace_matches(c, _run("[a-zA-Z]"), lambda m: F.concat(_lead(m), sub(m, r"\s+", "")))


def merge_fragments(c: Column) -> Column:
    """Glue runs of short uncommon tokens when the result has five letters and a vowel; blanks are normalised."""
    token = rf"(?!(?iu:{'|'.join(P.FRAGMENT_COMMON)})(?![^ ]))\p{{L}}{{1,3}}(?![^ ])"

    def glue(m: Column) -> Column:
        joined = F.replace(m, F.lit(" "), F.lit(""))
        good = (F.length(joined) >= 5) & matches(joined, "(?i)[aeiouy]")
        return F.when(good, joined).otherwise(m)

    # possessive: a run of any length is matched without a stack frame per token
    return replace_matches(c, rf"(?<![^ ]){token}(?: {token})++", glue)


def single_blanks(c: Column) -> Column:
    """White space as single blanks; a text of one token stays as it is."""
    return F.when(matches(strip(c), r"\s"), sub(strip(c), r"\s+", " ")).otherwise(c)


def _line_hyphens(c: Column) -> Column:
    """Hyphen at a line end: lower case joins, two capital parts join, everything else keeps the hyphen."""

    def join(m: Column) -> Column:
        a = F.regexp_extract(m, r"^([\p{L}0-9]+)", 1)
        b = F.regexp_extract(m, r"([\p{L}0-9]+)$", 1)
        lower = matches(b, r"^[^\p{Lu}]") & ~matches(b, rf"^{_CONNECT}$")
        capital = (a == F.upper(a)) & (b == F.upper(b)) & (F.length(a) > 1) & (F.length(b) > 1)
        return F.when(lower | capital, F.concat(a, b)).otherwise(F.concat(a, F.lit("-"), b))

    return replace_matches(c, r"[\p{L}0-9]+[\-‐–]\s*[\r\n]+\s*[\p{L}0-9]+", join)


def extended_repair_steps() -> list:
    """The web repair, in order."""
    typos = [_fixed_typos, _syllables, merge_syllables]
    return [
        lambda c: sub(c, "[­​]", ""),
        *typos,
        _line_hyphens,
        lambda c: dehyphenate(c, "web"),
        lambda c: _spaced_hyphens(c, "web"),
        lambda c: _families(c, "web"),
        spaced_letters,
        *typos,
    ]


# --- forms, signs, contractions, abbreviations, quotes (C07-C11) -----------------------------------------------------


def form_blanks(c: Column, generic: str = " ") -> Column:
    """Spoken phrases for fill-in lines; ``generic`` replaces the underscores that are left."""
    t = c
    for pattern, phrase in P.FORM_BLANKS:
        start = "" if pattern.startswith(r"\$") else P.WB
        t = sub(t, rf"(?i){start}{pattern}", phrase)
    t = strip(sub(sub(t, "_{2,}", generic), r"[ \t]{2,}", " "))
    return F.when(F.contains(c, F.lit("_")), t).otherwise(c)


def signs(c: Column) -> Column:
    """A sign after a decimal amount moves in front of it."""
    amount = r"\d+[.,]\d+"
    return replace_matches(
        c,
        rf"{amount}\s*[\-−+](?=$|\s|[,;.)\]])",
        lambda m: F.concat(
            F.when(F.endswith(m, F.lit("+")), "+").otherwise("-"), F.regexp_extract(m, rf"({amount})", 1)
        ),
    )


def _expanded(word: Column, table: dict[str, str], otherwise: Column) -> Column:
    """Entry of ``table`` with the capital of the word restored."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def cased(e: Column) -> Column:
        capital = matches(word, r"^\p{Lu}")
        return F.when(e.isNull(), otherwise).when(
            capital, F.concat(F.upper(F.substring(e, 1, 1)), F.substr(e, F.lit(2)))
        ).otherwise(e)

    return let(F.try_element_at(mapping, F.lower(word)), cased)


def contractions(c: Column) -> Column:
    """Expand known contractions; curly apostrophes become straight first."""
    straight = F.translate(c, "’‘", "''")
    return replace_matches(
        straight, rf"{P.WB}[A-Za-z]+'[a-z]+{P.WE}", lambda m: _expanded(m, P.CONTRACTIONS, m), "'"
    )


def abbreviations(c: Column) -> Column:
    """C10, dictionary part: words with an optional period."""
    words = "|".join(P.ABBREVIATIONS)
    return replace_matches(
        c, rf"(?i){_opening(P.ABBREVIATIONS)}{P.WB}(?:{words}){P.WE}\.?", lambda m: _expanded(F.rtrim(m, F.lit(".")), P.ABBREVIATIONS, m)
    )


def number_abbreviations(c: Column) -> Column:
    """C10, context part: "i.e." and marks that mean something only beside a number."""
    t = sub(c, rf"(?i)(?=i){P.WB}i\.e(?:\.(?=[{P.W}])|{P.WE})", "that is")
    t = sub(t, rf"(?i)(?=n){P.WB}No\.\s*(?=\d)", "Number ")
    t = sub(t, r"(?i)(?<=\d)\s*in\.(?=\s|$)", " inches")
    t = sub(t, rf"(?i)(?=c){P.WB}ca\.\s*(?=\d)", "about ")
    t = sub(t, r'(?<=\d)\s*"', " inches")
    return sub(t, rf"(?<=\d)\s*'{P.WE}", " feet")


def quotes(c: Column, profile: str = "page") -> Column:
    """C11: drop quotes and apostrophes; the web profile keeps apostrophes outside words."""
    if profile == "page":
        return F.translate(c, "\"'", "")
    t = F.translate(F.replace(c, F.lit('"'), F.lit("")), "’", "'")
    t = sub(t, rf"{_ASCII_START}([A-Za-z]+)'s{_ASCII_END}", "$1s")
    return sub(t, r"([A-Za-z0-9_])'([A-Za-z0-9_])", "$1$2")


# --- symbols, tables, boilerplate (C15-C19) ----------------------------------------------------------------------------


def clean_token(word: Column) -> Column:
    """One token without table glyphs, dingbats, leaders, empty brackets, edge noise and inner specks.

    A plain word with at most one closing mark passes all rules unchanged and skips them.
    """
    w = sub(sub(strip(word), f"[{P.BOX}]", ""), P.DINGBATS, "")
    w = sub(sub(w, P.SYMBOL_RUN, ""), P.DOT_LEADERS, " ")
    for left, right in (r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">"):
        w = sub(w, left + P.EMPTY_BRACKET + right, "")
    w = sub(w, rf"^{P.EDGE_NOISE}+|{P.EDGE_NOISE}+$", "")
    w = sub(w, r"([\p{L}0-9])[|*~#^\\=_+/]{2,}([\p{L}0-9])", "$1 $2")
    w = sub(w, r"(\p{L})[|~^\\_](\p{L})", "$1$2")
    cleaned = let(
        w,
        lambda t: F.when(matches(t, r"[\p{L}0-9]"), strip(t)).when(matches(t, r"^[.,;:!?…]$"), t).otherwise(""),
    )
    return F.when(matches(word, r"^[\p{L}0-9]+[.,;:!?]?$"), word).otherwise(cleaned)


def clean_tokens(c: Column) -> Column:
    """C15 over all tokens of a text, joined by single blanks."""
    return F.array_join(non_empty(F.transform(F.split(strip(c), r"\s+"), clean_token)), " ")


def table_noise(c: Column) -> Column:
    """Drop table lines, embedded borders, leaders and symbol rubbish line by line."""
    from quire.functions.noise import table_line

    def cleaned(line: Column) -> Column:
        t = sub(sub(line, r"^\s*\|\s*", " "), r"\s*\|\s*$", " ")
        t = sub(t, r"\s*\|\s*", " | ")
        t = sub(sub(t, f"[{P.BOX}]", " "), P.DOT_LEADERS, " ")
        return clean_tokens(t)

    lines = F.filter(F.split(c, r"[\r\n]+", -1), lambda s: ~table_line(s))
    return F.array_join(non_empty(F.transform(lines, cleaned)), "\n")


def boilerplate(c: Column) -> Column:
    """C17: order-form, inquiry-card and continuation phrases out; runs of underscores become a blank."""
    rules = [p.replace(r"\b", _ASCII_END) for p in P.JUNK_PHRASES]
    t = c
    for rule in rules:
        t = sub(t, f"(?i){_ASCII_START}{rule}", "")
    # where no rule matches the text as it is, none will
    touched = matches(c, f"(?i){P.JUNK_OPENING}{_ASCII_START}(?:{'|'.join(rules)})")
    return sub(F.when(touched, t).otherwise(c), "_{2,}", " ")


def scan_symbols(c: Column) -> Column:
    """First part of C19: borders, pipes, scanner symbols and symbol runs."""
    t = sub(c, f"[{P.BOX}]", " ")
    t = sub(t, r"(?m)^\s*\|\s*", "")
    t = sub(t, r"(?m)\s*\|\s*$", "")
    t = sub(t, r"\s*\|\s*", " ")
    t = sub(t, r"[{}\[\]\\~`^@£$§°%+=_<>#*]", " ")
    return sub(t, r"(?:^|\s)[|+\-=_~#*•·—–^\\/]{2,}(?:\s|\z)", " ")


def readable_lines(c: Column) -> Column:
    """Last part of C19: keep readable lines and tokens, joined by blank lines."""
    from quire.functions.noise import gibberish_line, gibberish_token, junk_line, table_line

    lines = non_empty(F.transform(F.split(c, r"\r?\n", -1), strip))
    lines = F.filter(lines, lambda s: ~table_line(s) & ~junk_line(s) & ~gibberish_line(s))

    def tokens(line: Column) -> Column:
        words = non_empty(F.transform(F.split(line, r"\s+"), clean_token))
        good = F.filter(words, lambda w: ~matches(w, r"^[~`^|\\/{}\[\]_+=$%*#@<>]$") & ~gibberish_token(w))
        return strip(sub(F.array_join(good, " "), r"\s{2,}", " "))

    kept = F.filter(F.transform(lines, tokens), lambda s: matches(s, r"[\p{L}0-9]"))
    return F.array_join(kept, "\n\n")


def speech_lines(c: Column) -> Column:
    """Line part of C12: bullets, numbering and stars out, blanks collapsed, empty lines dropped."""
    t = sub(c, r"\r\n?", "\n")
    bullet = r"^[\t ]*(?:[*•‣◦⁃∙\-–—]+|\d+[.)])\s+"
    lines = F.transform(
        F.split(t, "\n", -1), lambda s: strip(sub(sub(sub(s, bullet, ""), r"\*+", " "), r"[ \t]{2,}", " "))
    )
    return F.array_join(non_empty(lines), "\n")


# --- rules as data, with their hits (audit of C07-C11, C17) ---------------------------------------------------------------

#: (rule, pattern, replacement) in the order in which they are applied
Rule = tuple[str, str, str]


def form_rules(generic: str = " ") -> list[Rule]:
    """The rules behind ``form_blanks``; the rest of an underscore run comes last."""
    rules = [(phrase.strip(), f"(?i){'' if p.startswith(chr(92) + '$') else P.WB}{p}", phrase) for p, phrase in P.FORM_BLANKS]
    return [*rules, ("rest of a blank", "_{2,}", generic)]


def boilerplate_rules() -> list[Rule]:
    """The rules behind ``boilerplate``."""
    phrases = [(p, f"(?i){_ASCII_START}" + p.replace(r"\b", _ASCII_END), "") for p in P.JUNK_PHRASES]
    return [*phrases, ("underscores", "_{2,}", " ")]


def boilerplate_needed() -> str:
    """What stands in each text that one of ``boilerplate_rules`` changes."""
    return f"__|(?i){P.JUNK_OPENING}{_ASCII_START}(?:{'|'.join(p.replace(chr(92) + 'b', _ASCII_END) for p in P.JUNK_PHRASES)})"


def quote_rules() -> list[Rule]:
    """The rules behind ``quotes`` of the page profile."""
    return [("quote", '"', ""), ("apostrophe", "'", "")]


def word_hits(c: Column, pattern: str, table: dict[str, str]) -> Column:
    """``array<struct<rule, n>>`` of a rule pack that is a table of words, all matched by one pattern."""
    known = F.array(*[F.lit(w) for w in table])
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.lower(F.rtrim(m, F.lit(".")))), lambda m: F.array_contains(known, m))
    return F.transform(
        F.array_distinct(found), lambda w: F.struct(w.alias("rule"), F.size(F.filter(found, lambda x: x == w)).alias("n"))
    )


def contraction_hits(c: Column) -> Column:
    return word_hits(F.translate(c, "’‘", "''"), rf"(?=[A-Za-z]){P.WB}[A-Za-z]+'[a-z]+{P.WE}", P.CONTRACTIONS)


def abbreviation_hits(c: Column) -> Column:
    return word_hits(c, rf"(?i){_opening(P.ABBREVIATIONS)}{P.WB}(?:{'|'.join(P.ABBREVIATIONS)}){P.WE}\.?", P.ABBREVIATIONS)
