"""SQL twins of the cleaning rules.

RE2 has no look-around. Words are therefore marked first (start mark, word, end mark), which makes a boundary a plain
character; the marks are taken out again at the end.
"""

from __future__ import annotations

from quire.checks.sql_features import strip
from quire.checks.sql_views import lit
from quire.functions import patterns as P

A, Z, J = "\x01", "\x02", "\x03"
LOWER = "[a-zà-öø-ÿ]"
ANY = "[a-zà-öø-ÿA-ZÀ-ÖØ-ÞŸ]"


def sub(t: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({t}, {lit(pattern)}, {lit(replacement)}, 'g')"


def mark(t: str) -> str:
    return sub(t, r"([\p{L}\p{N}_]+)", A + r"\1" + Z)


def unmark(t: str) -> str:
    return sub(t, f"[{A}{Z}]", "")


def _connectors() -> str:
    return "|".join(c[0] + (f"(?i:{c[1:]})" if len(c) > 1 else "") for c in P.CONNECTORS)


def dehyphenate(t: str) -> str:
    t = mark(f"replace({t}, chr(173), '-')")
    for _ in range(3):
        t = sub(t, rf"{Z}-\s+{A}({_connectors()}){Z}", Z + "-" + A + r"\1" + Z)
    return unmark(sub(t, rf"{Z}-\s+{A}({LOWER})", r"\1"))


def repair_core(t: str) -> str:
    t = mark(f"replace(replace({t}, chr(173), ''), chr(8203), '')")
    w = r"[\p{L}\p{N}_]"
    t = sub(t, rf"{A}({w}{{2,}}){Z}\s*[\-‐–]\s+{A}({LOWER}{w}*){Z}", A + r"\1" + J + r"\2" + Z)
    t = sub(t, rf"{J}((?i:{'|'.join(P.CONNECTORS)})){Z}", Z + "-" + A + r"\1" + Z)
    t = sub(t, J, "")
    t = sub(t, rf"{A}((?i:{'|'.join(P.PREFIXES)})){Z}\s+{A}({ANY}{w}*){Z}", A + r"\1\2" + Z)
    t = sub(t, rf"{A}({ANY}{{3,}}){Z}\s+{A}((?i:{'|'.join(P.SUFFIXES)})){Z}", A + r"\1\2" + Z)
    for a, b in [*P.SPLIT_WORDS, *P.BROKEN_LETTERS]:
        t = sub(t, rf"{A}((?i:{a})){Z}\s+{A}((?i:{b})){Z}", A + r"\1\2" + Z)
    return unmark(t)


def form_blanks(t: str) -> str:
    """Underscore is a word character, so only the start of a word is marked here."""
    out = sub(t, r"(^|[^\p{L}\p{N}_])([\p{L}\p{N}_])", r"\1" + A + r"\2")
    for pattern, phrase in P.FORM_BLANKS:
        start = "" if pattern.startswith(r"\$") else A
        body = pattern.replace(r"\s*", rf"[\s{A}]*").replace("-?", f"-?{A}?")
        out = sub(out, f"(?i){start}{body}", phrase)
    out = sub(sub(sub(out, A, ""), "_{2,}", " "), r"[ \t]{2,}", " ")
    return f"CASE WHEN contains({t}, '_') THEN {strip(out)} ELSE {t} END"


def signs(t: str) -> str:
    t = sub(t, r"(\d+[.,]\d+)\s*[\-−]($|\s|[,;.)\]])", r"-\1\2")
    return sub(t, r"(\d+[.,]\d+)\s*\+($|\s|[,;.)\]])", r"+\1\2")


def _cased(word: str, expansion: str, tail: str, t: str, make) -> str:  # type: ignore[no-untyped-def]
    upper = expansion[0].upper() + expansion[1:]
    rest = f"(?i:{word[1:]})" if len(word) > 1 else ""
    t = sub(t, make(word[0].upper() + rest) + tail, upper)
    return sub(t, make(word[0] + rest) + tail, expansion)


def abbreviation_words(t: str) -> str:
    t = mark(t)
    for word, expansion in P.ABBREVIATIONS.items():
        t = _cased(word, expansion, r"\.?", t, lambda p: f"{A}{p}{Z}")
    return unmark(t)


def number_abbreviations(t: str) -> str:
    t = mark(t)
    t = sub(t, rf"(?i){A}i{Z}\.{A}e{Z}\.({A})", r"that is\1")
    t = sub(t, rf"(?i){A}i{Z}\.{A}e{Z}", "that is")
    t = sub(t, rf"(?i){A}No{Z}\.\s*{A}(\d)", A + r"Number \1")
    # the number word keeps its marks, so a digit is followed by an end mark
    t = sub(t, rf"(?i)(\d){Z}\s*{A}in{Z}\.(\s|$)", r"\1" + Z + r" inches\2")
    t = sub(t, rf"(?i)(\d)in{Z}\.(\s|$)", r"\1" + Z + r" inches\2")
    t = sub(t, rf"(?i){A}ca{Z}\.\s*{A}(\d)", A + r"about \1")
    t = sub(t, rf'(\d){Z}\s*"', r"\1" + Z + " inches")
    t = sub(t, rf"(\d){Z}\s*'([^{A}]|$)", r"\1" + Z + r" feet\2")
    return unmark(t)


def contractions(t: str) -> str:
    t = mark(f"translate({t}, '’‘', '''''')")
    for word, expansion in P.CONTRACTIONS.items():
        head, tail = word.split("'")
        t = _cased(head, expansion, "", t, lambda p, tail=tail: f"{A}{p}{Z}'{A}{tail}{Z}")
    return unmark(t)


def quotes(t: str) -> str:
    return f"replace(replace({t}, '\"', ''), '''', '')"


def boilerplate(t: str) -> str:
    for rule in P.JUNK_PHRASES:
        t = sub(t, rf"(?i)\b{rule}", "")
    return sub(t, "_{2,}", " ")


def clean_token(w: str) -> str:
    w = sub(sub(strip(w), f"[{P.BOX}]", ""), P.DINGBATS, "")
    w = sub(sub(w, P.SYMBOL_RUN, ""), P.DOT_LEADERS, " ")
    for left, right in (r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">"):
        w = sub(w, left + P.EMPTY_BRACKET + right, "")
    w = sub(sub(w, rf"^{P.EDGE_NOISE}+", ""), rf"{P.EDGE_NOISE}+$", "")
    w = sub(w, r"([\p{L}0-9])[|*~#^\\=_+/]{2,}([\p{L}0-9])", r"\1 \2")
    w = sub(w, r"(\p{L})[|~^\\_](\p{L})", r"\1\2")
    return w


def clean_tokens(t: str) -> str:
    """Tokens cleaned and joined by blanks."""
    toks = f"regexp_split_to_array({strip(t)}, '\\s+')"
    cleaned = f"list_transform({toks}, lambda w: {clean_token('w')})"
    kept = (
        f"list_transform({cleaned}, lambda w: CASE WHEN regexp_matches(w, '[\\p{{L}}0-9]') THEN {strip('w')} "
        f"WHEN regexp_full_match(w, '[.,;:!?…]') THEN w ELSE '' END)"
    )
    return f"coalesce(array_to_string(list_filter({kept}, lambda w: w <> ''), ' '), '')"


def speech_lines(t: str) -> str:
    bullet = r"^[\t ]*(?:[*\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}\-–—]+|\d+[.)])\s+"
    line = sub(sub(sub("l", bullet, ""), r"\*+", " "), r"[ \t]{2,}", " ")
    return (
        f"list_filter(list_transform(string_split(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)),"
        f" chr(10)), lambda l: {strip(line)}), lambda l: l <> '')"
    )




def replace_matches(t: str, pattern: str, change: str) -> str:
    """``change`` is an expression over ``m``, one match."""
    p = lit(pattern)
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, {p}), list_append(regexp_extract_all({t}, {p}), '')), "
        f"lambda e: e[1] || list_transform([e[2]], lambda m: CASE WHEN m = '' THEN '' ELSE {change} END)[1]), '')"
    )


def typos(t: str) -> str:
    t = sub(t, r"(?i)\blin\s*e\s*of\b", "line of")
    t = sub(t, r"(?i)\blin\s+e\b", "line")
    return sub(t, rf"(?i)\b({'|'.join(x[:-1] for x in P.FINAL_C)})c\b", r"\1e")


def known_syllables(t: str) -> str:
    experiment, broken = "|".join(P.EXPERIMENTATION), r"ex\s+pc\s+rimc\s+nt"
    known = "|".join(x.replace(" ", r"\s+") for x in sorted(P.SYLLABLES, key=len, reverse=True))
    change = (
        f"CASE WHEN regexp_full_match(m, {lit(f'(?i)(?:{experiment})')}) THEN 'experimentation' "
        f"WHEN regexp_full_match(m, {lit(f'(?i){broken}')}) THEN 'experiment' ELSE lower({sub('m', chr(92) + 's+', '')}) END"
    )
    return replace_matches(t, rf"(?i)\b(?:{experiment}|{broken}|{known})\b", change)


def line_hyphens(t: str) -> str:
    a, b = "regexp_extract(m, '^([\\p{L}0-9]+)', 1)", "regexp_extract(m, '([\\p{L}0-9]+)$', 1)"
    lower = f"(regexp_matches({b}, '^[^\\p{{Lu}}]') AND NOT regexp_full_match({b}, {lit('(?i:' + '|'.join(P.CONNECTORS) + ')')}))"
    capital = f"({a} = upper({a}) AND {b} = upper({b}) AND length({a}) > 1 AND length({b}) > 1)"
    change = f"CASE WHEN {lower} OR {capital} THEN {a} || {b} ELSE {a} || '-' || {b} END"
    return replace_matches(t, r"[\p{L}0-9]+[\-‐–]\s*[\r\n]+\s*[\p{L}0-9]+", change)


def dehyphenate_web(t: str) -> str:
    t = sub(f"replace({t}, chr(173), '')", r"([\p{L}0-9]+)", A + r"\1" + Z)
    for _ in range(3):
        t = sub(t, rf"{Z}-\s+{A}({_connectors()}){Z}", Z + "-" + A + r"\1" + Z)
    return unmark(sub(t, rf"{Z}-\s+{A}({LOWER})", r"\1"))


def spaced_hyphens_web(t: str) -> str:
    word, hyphen = r"\p{L}0-9", r"\s*[\-‐–]\s+"
    connects = f"regexp_matches(m, {lit('[' + chr(92) + '-‐–]' + chr(92) + 's+(?i:' + '|'.join(P.CONNECTORS) + ')$')})"
    change = f"CASE WHEN {connects} THEN {sub('m', hyphen, '-')} ELSE {sub('m', hyphen, '')} END"
    return replace_matches(t, rf"[{word}]{{2,}}\s+[\-‐–]\s+{LOWER}[{word}]*", change)


def families_web(t: str) -> list[str]:
    """The steps one after another, each over ``t``."""
    domain = "|".join(rf"(?:{a})\s+(?:{b})" for a, b in P.SPLIT_WORDS)
    first, *others = P.BROKEN_LETTERS
    tails = "|".join(rf"(?:{a})\s+(?:{b})" for a, b in others)
    close = sub("m", r"\s+", "")
    return [
        sub(t, rf"(?i)\b({'|'.join(P.PREFIXES)})\s+({LOWER}[\p{{L}}0-9]*)\b", r"\1\2"),
        sub(t, rf"(?i)(^|[^A-Za-z0-9_])({LOWER}{{3,}})\s+({'|'.join(P.SUFFIXES)})\b", r"\1\2\3"),
        replace_matches(t, rf"(?i)\b(?:{domain})\b", close),
        sub(t, rf"(?i)\b({first[0]})\s+({first[1]})\b", r"\1\2"),
        replace_matches(t, rf"(?i)\b(?:{tails})\b", close),
    ]


def run_views(name: str, source: str, letters: str, glue: str) -> dict[str, str]:
    """``v_<name>``: doc_id, t of ``source`` with runs of three or more tokens of ``letters`` glued where ``glue`` holds.

    A run takes the white-space character before it, of which only a blank is kept; its last token may have a mark behind it.
    """
    return {
        f"v_{name}_0": f"SELECT doc_id, regexp_extract_all(t, '\\S+') AS ws, regexp_split_to_array(t, '\\S+') AS seps FROM {source}",
        f"v_{name}_1": f"""
            SELECT doc_id, i, w, seps[i] AS sep, regexp_full_match(w, '{letters}') AS pure,
                   regexp_matches(w, '^{letters}[.,;:!?]') AS closing
            FROM (SELECT doc_id, seps, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM v_{name}_0)""",
        f"v_{name}_2": f"""
            SELECT *, sum(CASE WHEN (pure OR closing) AND coalesce(p, false) THEN 0 ELSE 1 END)
                     OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
            FROM (SELECT *, lag(pure) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM v_{name}_1)""",
        f"v_{name}_3": f"""
            SELECT doc_id, run, min(i) AS i, bool_and(pure OR closing) AND count(*) >= 3 AND {glue} AS glue,
                   string_agg(w, '' ORDER BY i) AS glued, arg_min(sep, i) AS lead, string_agg(sep || w, '' ORDER BY i) AS plain
            FROM v_{name}_2 GROUP BY doc_id, run""",
        f"v_{name}_4": f"""
            SELECT doc_id, string_agg(CASE WHEN glue THEN CASE WHEN suffix(lead, ' ') THEN lead ELSE lead[1:-2] END || glued
                                           ELSE plain END, '' ORDER BY i) AS t FROM v_{name}_3 GROUP BY doc_id""",
        f"v_{name}": f"SELECT z.doc_id, coalesce(s.t, '') || coalesce(z.seps[-1], '') AS t FROM v_{name}_0 z LEFT JOIN v_{name}_4 s USING (doc_id)",
    }


def extended_repair(name: str, source: str) -> dict[str, str]:
    """Views of the web repair over ``source(doc_id, t)``; the last one is ``v_<name>``."""
    core = "regexp_extract(w, '^[a-zA-Z]{1,3}')"
    known = ", ".join(lit(w) for w in P.STANDALONE_SHORT)
    syllable = f"NOT bool_or(lower({core}) IN ({known})) AND sum(length({core})) >= 4"
    views: dict[str, str] = {}
    at = source

    def add(*expressions: str) -> None:
        nonlocal at
        for expression in expressions:
            views[f"v_{name}_s{len(views)}"] = f"SELECT doc_id, {expression} AS t FROM {at}"
            at = f"v_{name}_s{len(views) - 1}"

    def runs(letters: str, glue: str) -> None:
        nonlocal at
        own = f"{name}_r{len(views)}"
        views.update(run_views(own, at, letters, glue))
        at = f"v_{own}"

    add(sub("t", "[\u00ad\u200b]", ""), typos("t"), known_syllables("t"))
    runs("[a-zA-Z]{1,3}", syllable)
    add(line_hyphens("t"), dehyphenate_web("t"), spaced_hyphens_web("t"), *families_web("t"))
    runs("[a-zA-Z]", "true")
    add(typos("t"), known_syllables("t"))
    runs("[a-zA-Z]{1,3}", syllable)
    views[f"v_{name}"] = f"SELECT doc_id, t FROM {at}"
    return views
