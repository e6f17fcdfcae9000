"""Registered queries over text cleaning (C) and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.checks import sql_clean as Q
from quire.checks.sql_features import rx, strip
from quire.checks.sql_layout import join_fold
from quire.checks.sql_noise import garbage_sql, table_sql
from quire.checks.sql_views import compose, lit
from quire.functions import noise as N
from quire.functions import patterns as P
from quire.functions.sentences import sentences as split_sentences
from quire.functions.text import text_lines
from quire.operators import cleaning as C
from quire.plans import views as V


def _job(job):  # type: ignore[no-untyped-def]
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return job(V.forms(spark, sf))

    return query


def _form_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.forms(spark, sf)
    return docs.select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("line_no", "text"))


def join_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.join_lines(_form_lines(spark, sf), ["doc_id"])


def line_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _form_lines(spark, sf).select("doc_id", "line_no", N.table_line(t).alias("is_table"))


def garbage_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _form_lines(spark, sf).select(
        "doc_id", "line_no", N.garbage(t).alias("is_garbage"), N.garbage(t, "web").alias("is_garbage_web")
    )


def boilerplate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _form_lines(spark, sf).select("doc_id", "line_no", N.junk_line(F.col("text")).alias("is_junk"))


def gibberish_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _form_lines(spark, sf).select("doc_id", "line_no", N.gibberish_line(F.col("text")).alias("is_gibberish"))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return split_sentences(V.forms(spark, sf))


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.issue_pages(spark, sf).select("issue_id", "page_no", F.col("raw_text").alias("text"))
    return C.apply_corrections(pages, V.corrections(spark, sf))


def clean_audit(spark: SparkSession, sf: str) -> DataFrame:
    jobs = {
        "form_blanks": C.expand_form_blanks,
        "quotes": C.strip_quotes,
        "signs": C.normalize_signs,
    }
    return C.clean_audit(V.forms(spark, sf), "text", jobs)


QUERIES = {
    "join_lines": join_lines,
    "dehyphenate": _job(C.dehyphenate),
    "repair_words": _job(C.repair_words),
    "repair_extended": _job(lambda d: C.repair_words(d, level="extended")),
    "syllables": _job(C.merge_syllables),
    "fragments": _job(C.merge_fragments),
    "form_blanks": _job(C.expand_form_blanks),
    "signs": _job(C.normalize_signs),
    "contractions": _job(C.expand_contractions),
    "abbreviations": _job(C.expand_abbreviations),
    "quotes": _job(C.strip_quotes),
    "normalize_text": _job(C.normalize_text),
    "garbage_lines": garbage_lines,
    "table_lines": line_flags,
    "token_symbols": _job(C.clean_tokens),
    "table_noise": _job(C.remove_table_noise),
    "boilerplate": _job(C.strip_boilerplate),
    "boilerplate_lines": boilerplate_lines,
    "gibberish_lines": gibberish_lines,
    "clean_ocr": _job(C.clean_ocr),
    "clean_for_speech": _job(C.clean_for_speech),
    "corrections": corrections,
    "sentences": sentences,
    "clean_audit": clean_audit,
    "rule_hits": _job(C.rule_hits),
}


def _forms(expr: str) -> str:
    return compose(f"SELECT doc_id, {expr} AS text FROM v_forms")


_LINES = {
    "v_form_lines": """
        SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM v_forms)""",
    "v_stripped": f"SELECT doc_id, line_no, {strip('text')} AS t FROM v_form_lines",
    "v_tokens": """
        SELECT doc_id, line_no, t, regexp_replace(regexp_replace(w, '^[^\\p{L}0-9]+', ''), '[^\\p{L}0-9]+$', '') AS w
        FROM (SELECT doc_id, line_no, t, unnest(regexp_split_to_array(t, '\\s+')) AS w FROM v_stripped WHERE t <> '')""",
}

_TWO = "(" + ", ".join(lit(w) for w in P.TWO_LETTER_WORDS) + ")"
_BAD = f"""CASE WHEN w = '' THEN 0
    WHEN regexp_full_match(w, '\\d+(?:\\.\\d+)?') OR {rx('w', P.SHORT_UNITS)} THEN 0
    WHEN regexp_full_match(w, '(?i)[bcdfghjklmnpqrstvwxyz]') THEN 1
    WHEN regexp_full_match(w, '[A-Za-z]{{2}}') AND lower(w) NOT IN {_TWO} THEN 1
    WHEN length(w) >= 4 AND regexp_matches(w, '[a-z]{{2,}}[A-Z]{{2,}}|[A-Z]{{2,}}[a-z]{{2,}}[A-Z]') THEN 1
    WHEN regexp_matches(w, '\\d') AND regexp_matches(w, '[A-Za-z]') AND {rx('w', P.TECH_CODES)} THEN 0
    WHEN regexp_matches(w, '\\d') AND regexp_matches(w, '[A-Za-z]')
         AND regexp_matches(w, '(?i)[a-z]\\d[a-z]|\\d[a-z]\\d[a-z]') THEN 1
    WHEN length(w) >= 3 AND NOT regexp_matches(w, '(?i)[aeiouy]')
         AND regexp_full_match(w, '(?i)[bcdfghjklmnpqrstvwxz]+') THEN 1 ELSE 0 END"""

_NORMAL = {
    "v_n1": f"SELECT doc_id, {join_fold(Q.speech_lines('text'))} AS t FROM v_forms",
    "v_n2": f"SELECT doc_id, {Q.dehyphenate('t')} AS t FROM v_n1",
    "v_n3": f"SELECT doc_id, {Q.repair_core('t')} AS t FROM v_n2",
    "v_n4": f"SELECT doc_id, {Q.form_blanks('t')} AS t FROM v_n3",
    "v_n5": f"SELECT doc_id, {Q.number_abbreviations(Q.abbreviation_words('t'))} AS t FROM v_n4",
    "v_n6": f"SELECT doc_id, {Q.quotes(Q.contractions('t'))} AS t FROM v_n5",
    "v_n7": f"SELECT doc_id, t, {strip('t')} AS s FROM v_n6",
}

_FRAGMENTS = {
    "v_f0": f"""
        SELECT doc_id, text, regexp_split_to_array({strip('text')}, '\\s+') AS ws FROM v_forms""",
    "v_f1": f"""
        SELECT doc_id, i, w, regexp_full_match(w, '\\p{{L}}{{1,3}}')
               AND lower(w) NOT IN ({', '.join(lit(w) for w in P.FRAGMENT_COMMON)}) AS short
        FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM v_f0 WHERE len(ws) > 1)""",
    "v_f2": """
        SELECT *, sum(CASE WHEN short AND coalesce(p, false) THEN 0 ELSE 1 END)
                 OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, lag(short) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM v_f1)""",
    "v_f3": """
        SELECT doc_id, run, CASE WHEN bool_and(short) AND length(string_agg(w, '')) >= 5
                 AND regexp_matches(string_agg(w, '' ORDER BY i), '(?i)[aeiouy]')
                 THEN string_agg(w, '' ORDER BY i) ELSE string_agg(w, ' ' ORDER BY i) END AS piece
        FROM v_f2 GROUP BY doc_id, run""",
}

_SYLLABLES = {
    "v_s0": """
        SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws, regexp_split_to_array(text, '\\S+') AS seps FROM v_forms""",
    "v_s1": """
        SELECT doc_id, i, w, seps[i] AS sep, regexp_full_match(w, '[a-zA-Z]{1,3}') AS pure,
               regexp_matches(w, '^[a-zA-Z]{1,3}[.,;:!?]') AS closing
        FROM (SELECT doc_id, seps, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM v_s0)""",
    "v_s2": """
        SELECT *, sum(CASE WHEN (pure OR closing) AND coalesce(p, false) THEN 0 ELSE 1 END)
                 OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, lag(pure) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM v_s1)""",
    "v_s3": f"""
        SELECT doc_id, run, min(i) AS i,
               bool_and(pure OR closing) AND count(*) >= 3
               AND NOT bool_or(lower(regexp_extract(w, '^[a-zA-Z]{{1,3}}')) IN
                     ({', '.join(lit(w) for w in P.STANDALONE_SHORT)}))
               AND sum(length(regexp_extract(w, '^[a-zA-Z]{{1,3}}'))) >= 4 AS glue,
               string_agg(w, '' ORDER BY i) AS glued, arg_min(sep, i) AS lead,
               string_agg(sep || w, '' ORDER BY i) AS plain
        FROM v_s2 GROUP BY doc_id, run""",
    "v_s4": """
        SELECT doc_id, string_agg(CASE WHEN glue THEN CASE WHEN suffix(lead, ' ') THEN lead ELSE lead[1:-2] END || glued
                                       ELSE plain END, '' ORDER BY i) AS text
        FROM v_s3 GROUP BY doc_id""",
}

SQL = {
    "join_lines": _forms(join_fold("string_split(text, chr(10))")),
    "dehyphenate": compose(
        f"SELECT doc_id, {Q.repair_core('t')} AS text FROM v_d1",
        {"v_d1": f"SELECT doc_id, {Q.dehyphenate('text')} AS t FROM v_forms"},
    ),
    "repair_words": _forms(Q.repair_core("text")),
    "syllables": compose(
        "SELECT doc_id, s.text || coalesce(z.seps[-1], '') AS text FROM v_s4 s JOIN v_s0 z USING (doc_id)", _SYLLABLES
    ),
    "fragments": compose(
        """SELECT doc_id, string_agg(piece, ' ' ORDER BY run) AS text FROM v_f3 GROUP BY doc_id
           UNION ALL SELECT doc_id, text FROM v_f0 WHERE len(ws) <= 1""",
        _FRAGMENTS,
    ),
    "form_blanks": _forms(Q.form_blanks("text")),
    "signs": _forms(Q.signs("text")),
    "contractions": _forms(Q.contractions("text")),
    "abbreviations": compose(
        f"SELECT doc_id, {Q.number_abbreviations('t')} AS text FROM v_a1",
        {"v_a1": f"SELECT doc_id, {Q.abbreviation_words('text')} AS t FROM v_forms"},
    ),
    "quotes": _forms(Q.quotes("text")),
    "normalize_text": compose(
        f"SELECT doc_id, CASE WHEN {garbage_sql('s')} THEN '' ELSE t END AS text FROM v_n7", _NORMAL
    ),
    "garbage_lines": compose(
        f"SELECT doc_id, line_no, {garbage_sql('t')} AS is_garbage, {garbage_sql('t', 'web')} AS is_garbage_web "
        "FROM v_stripped",
        _LINES,
    ),
    "table_lines": compose(f"SELECT doc_id, line_no, {table_sql('t')} AS is_table FROM v_stripped", _LINES),
    "token_symbols": _forms(Q.clean_tokens("text")),
    "table_noise": compose(
        f"""SELECT doc_id, coalesce(string_agg(c, chr(10) ORDER BY i) FILTER (WHERE c <> ''), '') AS text
            FROM (SELECT doc_id, i, CASE WHEN keep THEN {Q.clean_tokens('l')} ELSE '' END AS c FROM v_t1)
            GROUP BY doc_id""",
        {
            "v_t0": f"""SELECT doc_id, unnest(ls) AS l0, generate_subscripts(ls, 1) AS i
                        FROM (SELECT doc_id, regexp_split_to_array(text, '[\\r\\n]+') AS ls FROM v_forms)""",
            "v_t1": f"""
                SELECT doc_id, i, NOT {table_sql('s')} AS keep,
                       {Q.sub(Q.sub(Q.sub(Q.sub(Q.sub('l0', r'^\s*\|\s*', ' '), r'\s*\|\s*$', ' '), r'\s*\|\s*', ' | '),
                                    f'[{P.BOX}]', ' '), P.DOT_LEADERS, ' ')} AS l
                FROM (SELECT *, {strip('l0')} AS s FROM v_t0)""",
        },
    ),
    "boilerplate": _forms(Q.boilerplate("text")),
    "boilerplate_lines": compose(
        "SELECT doc_id, line_no, length(t) >= 3 AND (" + " OR ".join(rx("t", p) for p in P.JUNK_LINES)
        + ") AS is_junk FROM v_stripped", _LINES,
    ),
    "gibberish_lines": compose(
        f"""SELECT doc_id, line_no, coalesce(bad, false) AS is_gibberish FROM v_stripped LEFT JOIN (
              SELECT doc_id, line_no, sum({_BAD})::DOUBLE / count(*) >= 0.28 OR (count(*) >= 5 AND sum({_BAD}) >= 3) AS bad
              FROM v_tokens GROUP BY doc_id, line_no) USING (doc_id, line_no)""",
        _LINES,
    ),
    "corrections": compose("""
        SELECT issue_id, page_no, replace(replace(replace(raw_text, 'the ', 'teh '), 'teh ', 'THE '), 'de ', 'DE ') AS text
        FROM v_issue_pages"""),
    "sentences": compose("""
        SELECT doc_id, sent_no, text FROM (
          SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS sent_no
          FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
                   regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n+', chr(1), 'g'),
                   '([.!?…])\\s+(["''“‘(\\[]?[A-ZÀ-ÖÅ0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
                   lambda s: trim(s)), lambda s: s <> '') AS ss FROM v_forms))"""),
    "clean_audit": compose(f"""
        SELECT rule, count(*) AS rows, count(*) FILTER (WHERE r <> text) AS rows_changed,
               sum(length(text) - length(r)) AS chars_removed
        FROM (SELECT 'form_blanks' AS rule, text, {Q.form_blanks('text')} AS r FROM v_forms
              UNION ALL SELECT 'quotes', text, {Q.quotes('text')} FROM v_forms
              UNION ALL SELECT 'signs', text, {Q.signs('text')} FROM v_forms) GROUP BY rule"""),
}


def _rule_views(name: str, first: str, rules: list[tuple[str, str, str]]) -> dict[str, str]:
    """One view per rule that counts and replaces, and ``v_<name>_hits`` over all of them."""
    views = {f"v_{name}_0": f"SELECT doc_id, {first} AS t, 0 AS n FROM v_forms"}
    for i, (_, pattern, replacement) in enumerate(rules, 1):
        views[f"v_{name}_{i}"] = (
            f"SELECT doc_id, {Q.sub('t', pattern, replacement)} AS t, len(regexp_extract_all(t, {lit(pattern)})) AS n FROM v_{name}_{i - 1}"
        )
    views[f"v_{name}_hits"] = " UNION ALL ".join(
        f"SELECT {lit(name)} AS pack, {lit(rule)} AS rule, n FROM v_{name}_{i}" for i, (rule, _, _) in enumerate(rules, 1)
    )
    return views


def _form_rules() -> list[tuple[str, str, str]]:
    """Word starts are marked beforehand; a mark inside a match goes with it."""
    out = []
    for pattern, phrase in P.FORM_BLANKS:
        start = "" if pattern.startswith(r"\$") else Q.A
        out.append((phrase.strip(), f"(?i){start}" + pattern.replace(r"\s*", rf"[\s{Q.A}]*").replace("-?", f"-?{Q.A}?"), phrase))
    return [*out, ("rest of a blank", f"{Q.A}?_{{2,}}", " ")]


_STRAIGHT = "translate(text, '’‘', " + lit("''") + ")"
_WORDS = {
    "v_contraction_words": f"""
        SELECT doc_id, unnest(list_transform(regexp_extract_all({Q.mark(_STRAIGHT)}, '{Q.A}([A-Za-z]+{Q.Z}''{Q.A}[a-z]+){Q.Z}', 1),
               lambda m: lower(regexp_replace(m, '[{Q.A}{Q.Z}]', '', 'g')))) AS w FROM v_forms""",
    "v_abbreviation_words": f"""
        SELECT doc_id, unnest(list_transform(regexp_extract_all({Q.mark('text')}, '(?i){Q.A}({"|".join(P.ABBREVIATIONS)}){Q.Z}', 1),
               lambda m: lower(m))) AS w FROM v_forms""",
    "v_word_hits": " ".join(
        f"""{union} SELECT {lit(pack)} AS pack, w AS rule, count(*) AS n FROM {view}
            WHERE w IN ({", ".join(lit(w) for w in table)}) GROUP BY doc_id, w"""
        for union, pack, view, table in (
            ("", "contractions", "v_contraction_words", P.CONTRACTIONS),
            ("UNION ALL", "abbreviations", "v_abbreviation_words", P.ABBREVIATIONS),
        )
    ),
}
SQL["rule_hits"] = compose(
    """SELECT pack, rule, count(*) AS pages_hit, sum(n)::BIGINT AS replacements FROM (
         SELECT * FROM v_form_blanks_hits UNION ALL SELECT * FROM v_boilerplate_hits UNION ALL SELECT * FROM v_quotes_hits
         UNION ALL SELECT * FROM v_word_hits) WHERE n > 0 GROUP BY pack, rule""",
    {
        **_rule_views("form_blanks", Q.sub("text", r"(^|[^\p{L}\p{N}_])([\p{L}\p{N}_])", r"\1" + Q.A + r"\2"), _form_rules()),
        **_rule_views("boilerplate", "text", [*[(p, rf"(?i)\b{p}", "") for p in P.JUNK_PHRASES], ("underscores", "_{2,}", " ")]),
        **_rule_views("quotes", "text", [("quote", '"', ""), ("apostrophe", "'", "")]),
        **_WORDS,
    },
)


SQL["repair_extended"] = compose(
    "SELECT doc_id, t AS text FROM v_ext", {"v_ext0": "SELECT doc_id, text AS t FROM v_forms", **Q.extended_repair("ext", "v_ext0")}
)


def _chain(name: str, source: str, expressions: list[str]) -> dict[str, str]:
    """One view per expression over ``t``; the last one is ``v_<name>``."""
    views, at = {}, source
    for i, expression in enumerate(expressions):
        own = f"v_{name}" if i == len(expressions) - 1 else f"v_{name}_c{i}"
        views[own] = f"SELECT doc_id, {expression} AS t FROM {at}"
        at = own
    return views


_SCAN = [
    Q.sub("t", pattern, new)
    for pattern, new in (
        (f"[{P.BOX}]", " "), (r"(?m)^\s*\|\s*", ""), (r"(?m)\s*\|\s*$", ""), (r"\s*\|\s*", " "),
        (r"[{}\[\]\\~`^@£$§°%+=_<>#*]", " "), (r"(?:^|\s)[|+\-=_~#*•·—–^\\/]{2,}(?:\s|\z)", " "),
    )
]
_JUNK = "(length(t) >= 3 AND (" + " OR ".join(rx("t", p) for p in P.JUNK_LINES) + "))"


def _edgeless(w: str) -> str:
    return f"regexp_replace(regexp_replace({w}, '^[^\\p{{L}}0-9]+', ''), '[^\\p{{L}}0-9]+$', '')"


_OCR = {
    "v_oc_in": "SELECT doc_id, text AS t FROM v_forms",
    **_chain("oc_scan", "v_oc_in", [*_SCAN, Q.boilerplate("t")]),
    **Q.run_views("oc_letters", "v_oc_scan", "[a-zA-Z]", "true"),
    **Q.extended_repair("oc_ext", "v_oc_letters"),
    "v_oc_lines": f"""
        SELECT doc_id, line_no, {strip('l')} AS t FROM (
          SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS line_no
          FROM (SELECT doc_id, regexp_split_to_array(t, '\\r?\\n') AS ls FROM v_oc_ext)) WHERE {strip('l')} <> ''""",
    "v_oc_tokens": """
        SELECT doc_id, line_no, t, unnest(ws) AS raw, generate_subscripts(ws, 1) AS i
        FROM (SELECT *, regexp_split_to_array(t, '\\s+') AS ws FROM v_oc_lines)""",
    "v_oc_bad": f"""
        SELECT doc_id, line_no, sum({_BAD})::DOUBLE / count(*) >= 0.28 OR (count(*) >= 5 AND sum({_BAD}) >= 3) AS bad
        FROM (SELECT *, {_edgeless('raw')} AS w FROM v_oc_tokens) GROUP BY doc_id, line_no""",
    "v_oc_kept": f"""
        SELECT doc_id, line_no FROM v_oc_lines JOIN v_oc_bad USING (doc_id, line_no) WHERE NOT bad AND NOT {table_sql('t')} AND NOT {_JUNK}""",
    "v_oc_clean": f"""
        SELECT doc_id, line_no, i,
               CASE WHEN regexp_matches(c, '[\\p{{L}}0-9]') THEN {strip('c')} WHEN regexp_full_match(c, '[.,;:!?…]') THEN c ELSE '' END AS c
        FROM (SELECT *, {Q.clean_token('raw')} AS c FROM v_oc_tokens JOIN v_oc_kept USING (doc_id, line_no))""",
    "v_oc_words": f"""
        SELECT doc_id, line_no, i, c FROM (SELECT *, {_edgeless('c')} AS w FROM v_oc_clean WHERE c <> '')
        WHERE NOT regexp_full_match(c, '[~`^|\\\\/{{}}\\[\\]_+=$%*#@<>]') AND {_BAD} = 0""",
    "v_oc_texts": f"""
        SELECT doc_id, line_no, {strip("regexp_replace(string_agg(c, ' ' ORDER BY i), '\\s{2,}', ' ', 'g')")} AS l
        FROM v_oc_words GROUP BY doc_id, line_no""",
}
SQL["clean_ocr"] = compose(
    """SELECT f.doc_id, coalesce(x.text, '') AS text FROM v_forms f LEFT JOIN (
         SELECT doc_id, string_agg(l, chr(10) || chr(10) ORDER BY line_no) AS text FROM v_oc_texts
         WHERE regexp_matches(l, '[\\p{L}0-9]') GROUP BY doc_id) x USING (doc_id)""",
    _OCR,
)

_SPEAKABLE = "CASE WHEN regexp_matches(t, '[\\p{L}0-9]') THEN t ELSE '' END"
_STRAIGHT_T = "replace(replace(t, '\"', ''), '’', " + lit("'") + ")"
_WEB_QUOTES = Q.sub(Q.sub(_STRAIGHT_T, r"\b([A-Za-z]+)'s\b", r"\1s"), "([A-Za-z0-9_])'([A-Za-z0-9_])", r"\1\2")
_TABLE_MARKS = Q.sub(Q.sub(Q.sub("l0", r"^\s*\|\s*", " "), r"\s*\|\s*$", " "), r"\s*\|\s*", " | ")
SQL["clean_for_speech"] = compose(
    "SELECT doc_id, t AS text FROM v_sp_out",
    {
        "v_sp_in": f"""
            SELECT doc_id, CASE WHEN {table_sql('s')} THEN '' ELSE text END AS t FROM (SELECT *, {strip('text')} AS s FROM v_forms)""",
        "v_sp_lines": f"""
            SELECT doc_id, i, CASE WHEN {table_sql('s')} THEN '' ELSE {Q.clean_tokens('l')} END AS c
            FROM (SELECT doc_id, i, {strip('l0')} AS s, {Q.sub(Q.sub(_TABLE_MARKS, f'[{P.BOX}]', ' '), P.DOT_LEADERS, ' ')} AS l
                  FROM (SELECT doc_id, unnest(ls) AS l0, generate_subscripts(ls, 1) AS i
                        FROM (SELECT doc_id, regexp_split_to_array(t, '[\\r\\n]+') AS ls FROM v_sp_in)))""",
        "v_sp_plain": """
            SELECT doc_id, coalesce(string_agg(c, chr(10) ORDER BY i) FILTER (WHERE c <> ''), '') AS t FROM v_sp_lines GROUP BY doc_id""",
        "v_sp_say": f"SELECT doc_id, {_SPEAKABLE} AS t FROM v_sp_plain",
        **Q.extended_repair("sp_ext", "v_sp_say"),
        **_chain("sp_out", "v_sp_ext", [
            Q.form_blanks("t"), Q.signs("t"), Q.contractions("t"), Q.abbreviation_words("t"), Q.number_abbreviations("t"), _WEB_QUOTES,
            Q.clean_tokens("t"), strip(Q.sub("t", r"[ \t]{2,}", " ")), _SPEAKABLE,
        ]),
    },
)
