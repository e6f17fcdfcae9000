"""SQL twins of page features."""

from __future__ import annotations

from quire.checks.sql_views import compose, lit
from quire.functions import patterns as P
from quire.functions.scores import ad_cue_pattern


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def cnt(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(pattern)}))"


WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def distinct_numbers(text: str, pattern: str) -> str:
    """Distinct numbers in order of first appearance."""
    nums = f"list_transform(regexp_extract_all({text}, {lit(pattern)}, 1), lambda s: CAST(s AS INT))"
    return (
        f"coalesce(list_filter({nums}, lambda x, i: list_position({nums}, x) = i), [])"
    )


def date_sql(t: str) -> str:
    return f"({rx(t, P.DATE_OR_TIME)} OR {rx(t, P.ISSUE_VOL)} OR ({rx(t, P.YEAR)} AND length({t}) <= 40))"


def url_sql(t: str) -> str:
    return f"({rx(t, P.FILE_OR_URL)} OR {rx(t, P.BROWSER_ARTIFACT)})"


LATIN_WORD = rf"[{P.LATIN}]{{2,}}"

FEATURE_VIEWS = {
    "v_feat0": f"""
        SELECT issue_id, page_no, n, k, label, raw_text,
               {distinct_numbers('raw_text', P.CONTINUED_ON)} AS con,
               {distinct_numbers('raw_text', P.CONTINUED_FROM)} AS cfrom,
               regexp_extract_all(raw_text, {lit(LATIN_WORD)}) AS alpha,
               regexp_extract_all(raw_text, '\\S+') AS toks,
               greatest(1, {cnt('raw_text', '[.!?…]')}) AS sents,
               length({strip('raw_text')}) AS chars,
               {cnt('raw_text', ad_cue_pattern())} AS hits,
               {cnt('raw_text', ad_cue_pattern('web'))} AS hits_web,
               {cnt('raw_text', '!')} AS bangs,
               {rx('raw_text', P.SHOUT)} AS shout, {rx('raw_text', P.SHOUT_WEB)} AS shout_web,
               {cnt('raw_text', '_{2,}')} AS unders, {rx('raw_text', P.FORM_AD)} AS form_phrase,
               list_filter(list_transform(string_split(raw_text, chr(10)), lambda s: {strip('s')}),
                           lambda s: s <> '') AS ls
        FROM v_cue_pages""",
    "v_feat1": f"""
        SELECT *, len(toks) AS words, len(ls) AS n_ls,
               len(list_filter(toks, lambda w: length(w) >= 3 AND regexp_matches(w, '\\p{{Lu}}')
                               AND NOT regexp_matches(w, '\\p{{Ll}}'))) AS caps,
               len(list_filter(alpha, lambda w: regexp_full_match(w, {lit(f'[{P.LATIN_UPPER}]{{2,}}')}))) AS caps2,
               CASE WHEN len(alpha) = 0 THEN 0.0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE,
                 least(0.4::DOUBLE, len(alpha)::DOUBLE / 80) + least(0.3::DOUBLE, sents::DOUBLE / 6)
                 + CASE WHEN list_sum(list_transform(alpha, lambda w: length(w)))::DOUBLE / len(alpha) >= 4.2
                        THEN 0.2::DOUBLE ELSE 0::DOUBLE END
                 - least(0.4::DOUBLE, len(list_filter(alpha, lambda w: regexp_full_match(w,
                      {lit(f'[{P.LATIN_UPPER}]{{3,}}')})))::DOUBLE / len(alpha) * 0.8::DOUBLE))) END AS prose
        FROM v_feat0""",
    "v_feat2": """
        SELECT *, hits::DOUBLE / greatest(words, 1) AS density, hits_web::DOUBLE / greatest(words, 1) AS density_web,
               caps2::DOUBLE / greatest(1, len(alpha)) AS caps_ratio,
               len(cfrom) > 0 OR (len(con) > 0 AND length(raw_text) > 250 AND prose >= 0.35) AS protected,
               len(cfrom) = 0 AND (unders >= 3 OR (unders >= 1 AND form_phrase) OR (form_phrase AND prose < 0.55))
                 AS is_form
        FROM v_feat1""",
    "v_feat3": """
        SELECT *, CASE WHEN protected THEN NULL
            WHEN contains(raw_text, '!!!') OR bangs >= 4 THEN 'bangs'
            WHEN shout THEN 'shout'
            WHEN words < 80 AND len(alpha) > 0 AND caps_ratio >= 0.25 THEN 'caps'
            WHEN hits >= 2 THEN 'cues'
            WHEN hits >= 1 AND chars < 450 AND prose < 0.45 THEN 'cue_short'
            WHEN density >= 0.05 AND words >= 12 THEN 'density'
            WHEN n_ls >= 6 AND prose < 0.45 AND words::DOUBLE / n_ls <= 3.5 THEN 'fragments'
            WHEN chars < 90 AND prose < 0.25 THEN 'tiny'
            WHEN chars < 220 AND caps >= 6 AND prose < 0.3 THEN 'short_caps'
            WHEN chars < 160 AND hits >= 1 THEN 'short_cue'
            WHEN chars < 280 AND prose < 0.28 AND words < 45 THEN 'sparse'
            WHEN chars < 350 AND prose < 0.22 AND caps >= 4 THEN 'sparse_caps'
            WHEN is_form THEN 'form' END AS first_rule,
            CAST(regexp_extract(label, '(?i)^\\s*page\\s+(\\d+)', 1) AS INT) AS pdf_no
        FROM v_feat2""",
    "v_folio": f"""
        SELECT issue_id, page_no,
               list_transform(list_filter(ls, lambda s: regexp_matches(s, {lit(P.FOLIO_LINE)})),
                 lambda s: CAST(regexp_extract(s, {lit(P.FOLIO_LINE)}, 1) AS INT))[-1] AS folio,
               list_transform(list_filter(CASE WHEN len(ls) <= 6 THEN ls ELSE list_concat(ls[1:3], ls[-3:]) END,
                   lambda s: regexp_matches(s, {lit(P.FOLIO_LINE)})),
                 lambda s: CAST(regexp_extract(s, {lit(P.FOLIO_LINE)}, 1) AS INT)) AS edges0
        FROM v_feat0""",
    "v_title_lines": f"""
        SELECT issue_id, page_no, i, s, length(s) AS len, {cnt('s', f'[{P.LATIN}]')} AS letters,
               {cnt('s', f'[{P.LATIN_UPPER}]')} AS uppers, {cnt('s', '[A-Z]')} AS asc_up
        FROM (SELECT issue_id, page_no, unnest(ls[1:12]) AS s, generate_subscripts(ls[1:12], 1) - 1 AS i FROM v_feat0)
        """,
    "v_title_scores": f"""
        SELECT issue_id, page_no, i, s,
               10.0 - i * 0.5 + CASE WHEN len BETWEEN 8 AND 60 THEN 3.0 WHEN len > 80 THEN -2.0 ELSE 0 END
               + CASE WHEN letters > 0 AND uppers::DOUBLE / letters > 0.7 THEN 2.0 ELSE 0 END
               + CASE WHEN regexp_matches(s, '^\\p{{Lu}}') AND contains(s, ' ') AND NOT suffix(s, '.')
                      THEN 1.5 ELSE 0 END AS score,
               10.0 - i * 0.5 + CASE WHEN len BETWEEN 8 AND 60 THEN 3.0 WHEN len > 80 THEN -2.0 ELSE 0 END
               + CASE WHEN {cnt('s', chr(92) + 'p{L}')} > 0
                       AND {cnt('s', chr(92) + 'p{Lu}')}::DOUBLE / {cnt('s', chr(92) + 'p{L}')} > 0.7
                      THEN 2.0 ELSE 0 END
               + CASE WHEN regexp_matches(s, '^[A-Z]') AND contains(s, ' ') AND NOT suffix(s, '.')
                      THEN 1.5 ELSE 0 END AS score_web,
               NOT ({url_sql('s')}) AND NOT ({date_sql('s')} AND len <= 45) AS web_ok
        FROM v_title_lines
        WHERE NOT {rx('s', P.CONT_NOISE)} AND NOT regexp_full_match(s, '\\d{{1,4}}') AND len >= 3""",
    "v_titles": """
        SELECT issue_id, page_no, arg_max(s, score * 1000 - i) AS title,
               arg_max(s, score_web * 1000 - i) FILTER (WHERE web_ok) AS web_title
        FROM v_title_scores GROUP BY issue_id, page_no""",
    "v_feat": """
        SELECT f.*, first_rule IS NOT NULL AS is_ad, o.folio, list_distinct(o.edges0) AS edges, t.title, t.web_title,
               first_rule IS NULL AND (len(cfrom) > 0 OR (chars >= 120 AND prose >= 0.35)) AS is_body
        FROM v_feat3 f JOIN v_folio o USING (issue_id, page_no) LEFT JOIN v_titles t USING (issue_id, page_no)""",
}


def q(body: str, extra: dict[str, str] | None = None) -> str:
    return compose(body, {**FEATURE_VIEWS, **(extra or {})})
