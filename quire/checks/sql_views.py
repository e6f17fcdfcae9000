"""SQL twins of the input views, and a composer that adds the needed ones in front of a check query."""

from __future__ import annotations

import re

from quire.plans.views import FORM_PHRASES


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


_PHRASES = "[" + ", ".join(lit(p) for p in FORM_PHRASES) + "]"

VIEWS: dict[str, str] = {
    "v_issue_pages": """
        SELECT source AS issue_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no,
               count(*) OVER (PARTITION BY source) AS n,
               'Page ' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS label,
               800 AS width, 1100 AS height, text AS raw_text
        FROM documents""",
    "v_cue_base": """
        SELECT *, CAST(regexp_extract(issue_id, '(\\d+)', 1) AS INT) % 3 AS k,
               page_no - CAST(regexp_extract(issue_id, '(\\d+)', 1) AS INT) % 3 AS printed, page_no % 7 AS m
        FROM v_issue_pages""",
    "v_cue_pages": """
        SELECT issue_id, page_no, n, label, width, height, k, printed,
               concat_ws(chr(10),
                 CASE WHEN m = 3 AND printed > 2 THEN 'Continued from page ' || (printed - 2)
                      WHEN m = 4 AND page_no > 6 AND printed > 6 THEN 'Continued from page ' || (printed - 6) END,
                 raw_text,
                 CASE WHEN m = 2 AND page_no % 2 = 0
                      THEN 'Buy now and save $5! Order today, limited time special offer.' END,
                 CASE WHEN m = 1 AND page_no + 2 <= n AND printed + 2 > 0 THEN 'Continued on page ' || (printed + 2)
                      WHEN m = 5 AND page_no + 6 <= n AND printed + 6 > 0 THEN 'Continued on page ' || (printed + 6) END,
                 CASE WHEN page_no % 5 <> 0 AND printed > 0 THEN CAST(printed AS VARCHAR) END) AS raw_text
        FROM v_cue_base""",
    "v_page_lines0": """
        SELECT issue_id, page_no, label, unnest(ls) AS text, generate_subscripts(ls, 1) AS line_no, len(ls) AS n_lines
        FROM (SELECT issue_id, page_no, label,
                     list_filter(list_transform(string_split(raw_text, chr(10)), lambda s: trim(s)),
                                 lambda s: s <> '') AS ls
              FROM v_cue_pages)""",
    "v_lines": """
        SELECT issue_id, page_no, line_no, label, n_lines,
               CASE WHEN n_lines >= 6 AND page_no % 4 = 1 AND line_no = 7 THEN repeat('─', 12)
                    WHEN n_lines >= 6 AND page_no % 4 = 2 AND line_no = 8 THEN '--------'
                    WHEN page_no % 6 = 0 AND line_no = 2 THEN 'SPEECH'
                    WHEN page_no % 6 = 0 AND line_no = 3 THEN 'SYNTHESIS' ELSE text END AS text,
               CASE WHEN n_lines >= 6 AND page_no % 4 = 1 AND line_no = 7 THEN 40
                    WHEN n_lines >= 6 THEN 40 + 200 * ((line_no - 1) % 3) ELSE 50 END AS "left",
               CASE WHEN n_lines >= 6 THEN 100 + 30 * ((line_no - 1) // 3) + 5 * ((line_no - 1) % 3)
                         + CASE WHEN (line_no - 1) // 3 >= 4 THEN 120 ELSE 0 END
                    ELSE 145 + 24 * (line_no - 1) END AS top,
               CASE WHEN n_lines >= 6 AND page_no % 4 = 1 AND line_no = 7 THEN 560
                    WHEN n_lines >= 6 THEN 160 ELSE 700 END AS width,
               CASE WHEN n_lines >= 6 THEN 14 + 2 * (line_no % 2) ELSE 18 END AS height
        FROM v_page_lines0""",
    "v_ocr_lines": """
        SELECT issue_id, page_no, line_no, "left", top, width, height, n_lines,
               CASE WHEN line_no % 7 = 0 THEN '§§§ |||'
                    WHEN line_no % 3 = 0 THEN replace(text, 'o', '0') ELSE text END AS text
        FROM v_lines""",
    "v_word_base": """
        SELECT issue_id, page_no, line_no, text, "left", top, width, height,
               CASE WHEN n_lines >= 6 THEN (line_no - 1) % 3 ELSE 0 END AS block_num, 0 AS par_num,
               CASE WHEN n_lines >= 6 THEN (line_no - 1) // 3 ELSE line_no - 1 END AS line_num
        FROM v_lines""",
    "v_words": """
        SELECT issue_id, page_no, block_num, par_num, line_num, word_no - 1 AS word_no, 5 AS level, w AS text,
               "left" + 10 * (word_no - 1) AS "left", top, 9 AS width, height
        FROM (SELECT *, unnest(ws) AS w, generate_subscripts(ws, 1) AS word_no
              FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM v_word_base))
        UNION ALL
        SELECT issue_id, page_no, block_num, par_num, line_num, 0, 4, text, "left", top, width, height
        FROM v_word_base WHERE page_no % 4 = 0""",
    "v_requests": """
        SELECT event_id AS request_id, e.issue_id, (event_id % (coalesce(n * 6 // 5, 0) + 1) + 1)::INT AS number, ts
        FROM (SELECT *, 'src' || (user_id % 20) AS issue_id FROM events) e
        LEFT JOIN (SELECT source AS issue_id, count(*) AS n FROM documents GROUP BY source) c USING (issue_id)""",
    "v_proof_first": """
        SELECT issue_id, page_no, CASE WHEN page_no % 6 = 0 THEN upper(label) ELSE label END AS label,
               CASE WHEN page_no % 9 = 0 THEN '[[SKIP_AS_AD]]' || chr(10) ELSE '' END
               || substring(raw_text, 1, length(raw_text) // 2) || chr(10) || chr(10)
               || substring(raw_text, length(raw_text) // 2 + 1) AS body,
               1 AS version
        FROM v_issue_pages WHERE page_no % 3 = 0""",
    "v_proofs": """
        SELECT * FROM v_proof_first
        UNION ALL
        SELECT issue_id, page_no, label, 'v2 ' || body, 2 FROM v_proof_first WHERE page_no % 12 = 0""",
    "v_forms": f"""
        SELECT doc_id, text || chr(10) || ({_PHRASES})[doc_id % 10 + 1] AS text FROM documents""",
    "v_turns": """
        SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id""",
}


def compose(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it uses, directly or through other views, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                visit(known[name])
                ordered.append(name)

    visit(body)
    recursive = "RECURSIVE " if any("_rec_" in n for n in ordered) else ""
    ctes = ", ".join(f"{n} AS ({known[n]})" for n in ordered)
    return (f"WITH {recursive}{ctes} " if ctes else "") + body
