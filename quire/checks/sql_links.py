"""SQL twins of links, ads, articles and playlists."""

from __future__ import annotations

from quire.checks.sql_features import FEATURE_VIEWS, date_sql, url_sql
from quire.checks.sql_views import compose
from quire.functions import patterns as P

LINK_VIEWS = {
    **FEATURE_VIEWS,
    "v_off": """
        SELECT issue_id, coalesce(arg_min(pdf_no - folio, page_no)
                 FILTER (WHERE abs(pdf_no - folio) <= 10), 0) AS off,
               min(page_no) FILTER (WHERE abs(pdf_no - folio) <= 10) AS evidence
        FROM v_feat GROUP BY issue_id""",
    "v_fo": "SELECT f.*, off, pdf_no - off AS printed FROM v_feat f JOIN v_off USING (issue_id)",
    "v_cue_req": """
        SELECT issue_id, page_no AS src_page, printed AS source, off, unnest(con) AS target FROM v_fo""",
    "v_land": """
        SELECT r.*, CASE WHEN d.t1 IS NOT NULL THEN 1 WHEN d.t2 IS NOT NULL THEN 2 WHEN d.t3 IS NOT NULL THEN 3 END AS tier,
               coalesce(d.t1, d.t2, d.t3) AS dst_page
        FROM v_cue_req r LEFT JOIN LATERAL (
          SELECT min(page_no) FILTER (WHERE pdf_no = r.target + r.off) AS t1,
                 min(page_no) FILTER (WHERE len(cfrom) > 0 AND list_contains(edges, r.target)) AS t2,
                 min(page_no) FILTER (WHERE list_contains(edges, r.target)) AS t3
          FROM v_feat p WHERE p.issue_id = r.issue_id) d ON true""",
    "v_land_c": """
        SELECT l.*, CASE WHEN dst_page IS NULL THEN NULL ELSE coalesce(
            list_filter(generate_series(1, len(f.ls)), lambda i: list_contains(
                list_transform(regexp_extract_all(f.ls[i], '"""
    + P.CONTINUED_FROM.replace("'", "''")
    + """', 1), lambda s: CAST(s AS INT)), l.source))[1] - 1,
            list_filter(generate_series(1, len(f.ls)), lambda i: regexp_matches(f.ls[i], '"""
    + P.CONTINUED_FROM.replace("'", "''")
    + """'))[1] - 1, 0) END AS dst_chunk
        FROM v_land l LEFT JOIN v_feat0 f ON f.issue_id = l.issue_id AND f.page_no = l.dst_page""",
    "v_ad_l": """
        SELECT *, is_ad OR NOT is_body AND len(cfrom) = 0 AND ((chars < 400 AND prose < 0.35)
                                                            OR (chars < 600 AND prose < 0.28)) AS is_weak
        FROM v_fo""",
    "v_skip0": """
        SELECT c.issue_id, c.page_no AS src_page, a.page_no AS ad_page, d.page_no AS dst_page, c.printed AS source,
               coalesce(list_contains(d.cfrom, c.printed), false) AS named,
               coalesce(list_contains(d.cfrom, c.printed), false) OR coalesce(list_contains(c.con, d.printed), false)
                 AS linked,
               len(d.cfrom) > 0 AS has_from, a.is_ad AS a_ad, a.is_form AS a_form, a.is_weak AS a_weak,
               a.is_body AS a_body, d.is_body AS d_body, a.chars AS a_chars, a.prose AS a_prose,
               a.pdf_no = c.pdf_no + 1 AND d.pdf_no = c.pdf_no + 2 AS ins
        FROM v_ad_l c JOIN v_ad_l a ON a.issue_id = c.issue_id AND a.page_no = c.page_no + 1
        JOIN v_ad_l d ON d.issue_id = c.issue_id AND d.page_no = c.page_no + 2
        WHERE len(a.cfrom) = 0""",
    "v_skips": """
        SELECT issue_id, src_page, ad_page, dst_page, source FROM v_skip0
        WHERE linked AND (named OR (has_from AND a_ad)
          OR (ins AND (a_ad OR a_form OR a_weak) AND (d_body OR has_from))
          OR ((a_ad OR a_form OR a_weak) AND d_body AND (ins OR source IS NOT NULL))
          OR (a_form AND d_body) OR ((a_ad OR a_form) AND (d_body OR has_from)))
        AND ((a_ad OR a_form OR a_weak) OR named
          OR (ins AND has_from AND NOT a_body AND NOT (a_chars > 500 AND a_prose >= 0.4)))""",
    "v_run0": """
        SELECT f.issue_id, f.page_no, f.pdf_no, f.off, f.is_ad OR f.is_form AS ad,
               s.ad_page IS NOT NULL AND NOT (f.is_ad OR f.is_form) AS weak
        FROM v_fo f LEFT JOIN v_skips s ON s.issue_id = f.issue_id AND s.ad_page = f.page_no""",
    "v_run1": """
        SELECT *, ad OR (weak AND (page_no - coalesce(max(CASE WHEN NOT weak THEN page_no END) OVER (
                 PARTITION BY issue_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1)
               AS gone FROM v_run0""",
    "v_run2": """
        SELECT *, max(CASE WHEN NOT gone THEN page_no END) OVER (PARTITION BY issue_id ORDER BY page_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_read,
               min(CASE WHEN NOT gone THEN page_no END) OVER (PARTITION BY issue_id ORDER BY page_no
                    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_read,
               max(page_no) OVER (PARTITION BY issue_id) AS last_page
        FROM v_run1""",
    "v_runs": """
        SELECT issue_id, page_no, coalesce(prev_read + 1, 2) AS run_page, next_read AS resume_page FROM v_run2
        WHERE gone AND page_no >= coalesce(prev_read + 1, 2)
          AND NOT (page_no = coalesce(prev_read + 1, 2) AND page_no = last_page)""",
    "v_seen": """
        SELECT f.*, lead(f.page_no) OVER w AS b_page, lead(f.pdf_no) OVER w AS b_pdf, lead(printed) OVER w AS b_printed,
               lead(cfrom) OVER w AS b_from, lead(is_ad) OVER w AS b_ad
        FROM v_fo f ANTI JOIN v_runs r ON r.issue_id = f.issue_id AND r.page_no = f.page_no
        WINDOW w AS (PARTITION BY f.issue_id ORDER BY f.page_no)""",
    "v_edges": """
        SELECT issue_id, page_no AS src, b_page AS dst, 'next' AS kind FROM v_seen
        WHERE NOT is_ad AND NOT b_ad AND (b_page - page_no <= 2 OR abs(b_pdf - pdf_no) BETWEEN 1 AND 2
              OR list_contains(con, b_printed) OR list_contains(b_from, printed) OR (len(b_from) > 0 AND len(con) > 0))
        UNION ALL
        SELECT a.issue_id, a.page_no, b.page_no, 'cue'
        FROM v_seen a JOIN v_seen b ON a.issue_id = b.issue_id AND list_contains(a.con, b.printed)
        WHERE NOT a.is_ad AND NOT b.is_ad AND a.page_no <> b.page_no""",
    "v_links": "SELECT DISTINCT issue_id, src, dst FROM v_edges",
    "v_starts": """
        SELECT issue_id, page_no AS start_page, is_ad FROM v_feat""",
    "v_rec_back": """
        SELECT issue_id, start_page, start_page AS page_no FROM v_starts s
        WHERE NOT is_ad AND NOT EXISTS (SELECT 1 FROM v_runs r WHERE r.issue_id = s.issue_id AND r.page_no = s.start_page)
        UNION
        SELECT b.issue_id, b.start_page, l.src FROM v_rec_back b JOIN v_links l
          ON l.issue_id = b.issue_id AND l.dst = b.page_no""",
    "v_rec_fore": """
        SELECT issue_id, start_page, page_no FROM v_rec_back
        UNION
        SELECT b.issue_id, b.start_page, l.dst FROM v_rec_fore b JOIN v_links l
          ON l.issue_id = b.issue_id AND l.src = b.page_no""",
    "v_articles": """
        SELECT issue_id, start_page, page_no FROM v_rec_fore
        UNION ALL
        SELECT issue_id, start_page, start_page FROM v_starts s
        WHERE is_ad OR EXISTS (SELECT 1 FROM v_runs r WHERE r.issue_id = s.issue_id AND r.page_no = s.start_page)""",
    "v_article_of": """
        SELECT issue_id, start_page, min(start_page) OVER (PARTITION BY issue_id, pages) AS article
        FROM (SELECT issue_id, start_page, list_sort(list(page_no)) AS pages FROM v_articles GROUP BY ALL)""",
    "v_article_pages": """
        SELECT a.issue_id, o.article, a.page_no, coalesce(n.pos, 0) AS pos
        FROM v_articles a JOIN v_article_of o ON o.issue_id = a.issue_id AND o.start_page = a.start_page AND o.article = a.start_page
        LEFT JOIN (SELECT issue_id, page_no, row_number() OVER (PARTITION BY issue_id ORDER BY page_no) AS pos
                   FROM v_feat f WHERE NOT is_ad AND NOT EXISTS
                     (SELECT 1 FROM v_runs r WHERE r.issue_id = f.issue_id AND r.page_no = f.page_no)) n
          ON n.issue_id = a.issue_id AND n.page_no = a.page_no""",
    "v_toc": """
        SELECT issue_id, page_no - (page_no - 2) % 25 AS page_no,
               'Table of Contents' || chr(10) || string_agg(CASE WHEN ((page_no - 2) % 25) % 2 = 0
                   THEN 'Story ........ ' || page_no ELSE '* ' || coalesce(title, 'untitled') || ' *' END,
                 chr(10) ORDER BY page_no) AS raw_text
        FROM v_feat WHERE page_no >= 2 AND (page_no - 2) % 25 BETWEEN 1 AND 8 GROUP BY 1, 2""",
    "v_linkable": f"""
        SELECT issue_id, page_no, title, lower(title) AS low FROM v_feat
        WHERE length(title) > 6 AND NOT {date_sql('lower(title)')} AND NOT {url_sql('lower(title)')}""",
    "v_toc_chunks0": """
        SELECT issue_id, page_no AS toc_page, unnest(string_split(raw_text, chr(10))) AS text,
               generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS chunk_no FROM v_toc""",
    "v_toc_chunks": f"""
        SELECT * FROM v_toc_chunks0 WHERE NOT {date_sql('trim(text)')} AND NOT {url_sql('trim(text)')}""",
    "v_toc_hits": """
        SELECT c.issue_id, c.toc_page, c.chunk_no, t.page_no, 1 AS tier
        FROM v_toc_chunks c JOIN v_linkable t ON t.issue_id = c.issue_id AND t.page_no <> c.toc_page
             AND contains(lower(c.text), t.low)
        UNION ALL
        SELECT c.issue_id, c.toc_page, c.chunk_no, f.page_no, 2
        FROM v_toc_chunks c JOIN v_feat f ON f.issue_id = c.issue_id AND f.page_no <> c.toc_page
             AND NOT contains(lower(c.text), 'continued on')
             AND regexp_matches(c.text, '(?i)(?:\\b(?:page|p\\.?)\\s+|\\.{3,}\\s*)' || f.page_no || '\\b')""",
    "v_next": """
        SELECT f.issue_id, f.page_no,
               coalesce(l.dst_page, (SELECT min(g.page_no) FROM v_feat g
                  WHERE g.issue_id = f.issue_id AND g.page_no > f.page_no AND NOT EXISTS
                    (SELECT 1 FROM v_runs r WHERE r.issue_id = g.issue_id AND r.page_no = g.page_no))) AS next_page,
               CASE WHEN l.dst_page IS NOT NULL THEN l.dst_chunk ELSE 0 END AS next_chunk
        FROM v_feat f LEFT JOIN v_land_c l ON l.issue_id = f.issue_id AND l.src_page = f.page_no
             AND l.target = f.con[1]""",
    "v_rec_walk": """
        SELECT issue_id, 1::BIGINT AS page_no, 0 AS pos FROM v_off
        UNION
        SELECT w.issue_id, n.next_page, w.pos + 1 FROM v_rec_walk w JOIN v_next n USING (issue_id, page_no)
        WHERE n.next_page IS NOT NULL AND w.pos < 2000""",
    "v_play_order": """
        SELECT w.issue_id, w.page_no, w.pos, coalesce(max(n.next_chunk), 0) AS first_chunk
        FROM (SELECT issue_id, page_no, min(pos) AS pos FROM v_rec_walk GROUP BY ALL) w
        LEFT JOIN (SELECT p.issue_id, p.pos, n.next_page, n.next_chunk
                   FROM (SELECT issue_id, page_no, min(pos) AS pos FROM v_rec_walk GROUP BY ALL) p
                   JOIN v_next n USING (issue_id, page_no)) n
          ON n.issue_id = w.issue_id AND n.next_page = w.page_no AND n.pos = w.pos - 1
        GROUP BY w.issue_id, w.page_no, w.pos""",
}


def q(body: str, extra: dict[str, str] | None = None) -> str:
    return compose(body, {**LINK_VIEWS, **(extra or {})})


