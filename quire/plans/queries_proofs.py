"""Registered queries over proofread texts (C23, C24, D10, E16, E18-E21) and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.checks import sql_clean as Q
from quire.checks.sql_features import strip
from quire.checks.sql_views import compose
from quire.operators import proofs as E
from quire.plans import views as V

KEY = ("issue_id", "page_no")


def prompt_batches(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.issue_pages(spark, sf)
    text = F.when(F.col("page_no") % 2 == 0, F.replace("raw_text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("raw_text"))
    return E.build_batches(pages.withColumn("raw_text", text))


def parse_proofs(spark: SparkSession, sf: str) -> DataFrame:
    results = V.proofs(spark, sf)
    fenced = F.when(
        F.col("page_no") % 2 == 0, F.concat(F.lit("```text\n"), F.col("body"), F.lit("\n``` "))
    ).otherwise(F.col("body"))
    return E.parse_proofs(results.withColumn("body", fenced)).select(*KEY, "label", "version", "body", "is_ad")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return E.latest(V.proofs(spark, sf), ["issue_id", "label"]).select("issue_id", "label", "body")


def proof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.issue_pages(spark, sf).select(*KEY, "label")
    scanned = F.when(F.col("page_no") % 5 == 0, F.concat("label", F.lit(" · scan"))).otherwise(F.col("label"))
    return E.lookup_proofs(pages.withColumn("label", scanned), _stored(spark, sf))


def _session(spark: SparkSession, sf: str) -> DataFrame:
    return V.issue_pages(spark, sf).filter("page_no % 2 = 0").select(
        "issue_id", "label", F.col("raw_text").alias("body"), (F.col("page_no") % 4 == 0).alias("proofed")
    )


def proof_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return E.upsert_proofs(_stored(spark, sf), _session(spark, sf))


def proof_replace(spark: SparkSession, sf: str) -> DataFrame:
    return E.upsert_proofs(_stored(spark, sf), _session(spark, sf), replace=True, only_proofed=True)


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.layout_lines(spark, sf)
    chunks = lines.select(*KEY, (F.col("line_no") - 1).alias("chunk_no"), "text")
    news = V.proofs(spark, sf).select(
        *KEY, F.col("body").alias("text"), F.when(F.col("page_no") % 9 == 0, True).alias("is_ad"), "version"
    )
    return E.apply_overrides(chunks, news)


def progress(spark: SparkSession, sf: str) -> DataFrame:
    return E.proof_progress(V.issue_pages(spark, sf), _stored(spark, sf))


def anchor_proofs(spark: SparkSession, sf: str) -> DataFrame:
    parsed = E.parse_proofs(E.latest(V.proofs(spark, sf), list(KEY)))
    return E.anchor_proofs(parsed.select(*KEY, "body"), V.layout_lines(spark, sf))


def triage(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.issue_pages(spark, sf).select(*KEY, "width", "height")
    lines = V.ocr_lines(spark, sf).filter("page_no % 19 <> 0")
    return E.triage(lines, pages)


QUERIES = {
    "prompt_batches": prompt_batches,
    "parse_proofs": parse_proofs,
    "proof_lookup": proof_lookup,
    "proof_upsert": proof_upsert,
    "proof_replace": proof_replace,
    "overrides": overrides,
    "progress": progress,
    "anchor_proofs": anchor_proofs,
    "triage": triage,
}

_STORED = {
    "v_stored": "SELECT issue_id, label, arg_max(body, version) AS body FROM v_proofs GROUP BY issue_id, label",
    "v_session": """SELECT issue_id, label, raw_text AS body, page_no % 4 = 0 AS proofed FROM v_issue_pages
                    WHERE page_no % 2 = 0""",
    "v_labelled": """SELECT issue_id, page_no, CASE WHEN page_no % 5 = 0 THEN label || ' · scan' ELSE label END AS label
                     FROM v_issue_pages""",
}
_FULL = """SELECT issue_id, label, coalesce({}) AS body FROM v_stored s FULL JOIN (SELECT * FROM v_session{}) n
           USING (issue_id, label)"""

_BATCH = {
    "v_b0": f"""
        SELECT issue_id, page_no, {strip('t')} AS t FROM (SELECT issue_id, page_no, CASE WHEN page_no % 2 = 0
            THEN replace(raw_text, chr(10), chr(10) || chr(10)) ELSE raw_text END AS t FROM v_issue_pages)""",
    "v_b_para": """
        SELECT issue_id, page_no, para, p FROM (SELECT issue_id, page_no, unnest(ps) AS p, generate_subscripts(ps, 1) AS para
          FROM (SELECT issue_id, page_no, string_split(t, chr(10) || chr(10)) AS ps FROM v_b0 WHERE length(t) > 2000))""",
    "v_b_line": """
        SELECT issue_id, page_no, para, i, l FROM (SELECT issue_id, page_no, para, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
          FROM (SELECT issue_id, page_no, para, string_split(p, chr(10)) AS ls FROM v_b_para WHERE length(p) > 2000))
        WHERE l <> ''""",
    "v_b_units": """
        SELECT issue_id, page_no, para, 0 AS i, 0 AS k, p AS t, 2 AS sep, false AS over FROM v_b_para WHERE length(p) <= 2000
        UNION ALL
        SELECT issue_id, page_no, para, i, k, l[k * 2000 + 1:(k + 1) * 2000], 1, true
        FROM (SELECT *, unnest(generate_series(0, (length(l) - 1) // 2000)) AS k FROM v_b_line)""",
    "v_b_list": """
        SELECT issue_id, page_no, list({'n': length(t), 'sep': sep, 'over': over, 'para': para, 'b': [t]}
                 ORDER BY para, i, k) AS us FROM v_b_units GROUP BY issue_id, page_no""",
    "v_b_fold": """
        SELECT issue_id, page_no, list_reduce(us, lambda a, x: CASE
              WHEN (a.para <> x.para AND (a.over OR x.over)) OR (a.n > 0 AND a.n + x.sep + x.n > 2000)
                THEN {'n': x.n, 'sep': x.sep, 'over': x.over, 'para': x.para, 'b': list_append(a.b, x.b[1])}
              WHEN a.n = 0 THEN {'n': x.n, 'sep': x.sep, 'over': x.over, 'para': x.para, 'b': list_append(a.b[1:-2], x.b[1])}
              ELSE {'n': a.n + x.sep + x.n, 'sep': x.sep, 'over': x.over, 'para': x.para,
                    'b': list_append(a.b[1:-2], a.b[-1] || repeat(chr(10), x.sep) || x.b[1])} END).b AS b FROM v_b_list""",
    "v_b_all": """
        SELECT issue_id, page_no, [t] AS b FROM v_b0 WHERE length(t) <= 2000 AND t <> ''
        UNION ALL SELECT issue_id, page_no, list_filter(b, lambda s: s <> '') FROM v_b_fold""",
}

_PARSED = {
    "v_fenced": r"""
        SELECT issue_id, page_no, label, version, CASE WHEN page_no % 2 = 0 THEN '```text' || chr(10) || body || chr(10) || '``` '
               ELSE body END AS b FROM v_proofs""",
    "v_unfenced": f"""
        SELECT issue_id, page_no, label, version, CASE WHEN prefix({strip('b')}, '```') THEN
          {strip(r"regexp_replace(regexp_replace(" + strip('b') + r", '^```[^\n]*\n', ''), '\n```$', '')")} ELSE {strip('b')} END AS b
        FROM v_fenced""",
}

SQL = {
    "prompt_batches": compose("""
        SELECT issue_id, page_no, i AS batch_no, n AS n_batches, text
        FROM (SELECT issue_id, page_no, len(b) AS n, unnest(b) AS text, generate_subscripts(b, 1) AS i FROM v_b_all)""",
        _BATCH),
    "parse_proofs": compose(f"""
        SELECT issue_id, page_no, label, version, prefix(b, '[[SKIP_AS_AD]]') AS is_ad,
               {Q.repair_core(strip("regexp_replace(b, '^" + chr(92) + "s*" + chr(92) + "[" + chr(92) + "[SKIP_AS_AD" + chr(92) + "]" + chr(92) + "]', '')"))} AS body
        FROM v_unfenced""", _PARSED),
    "proof_lookup": compose("""
        SELECT p.issue_id, p.page_no, p.label, coalesce(a.body, b.body, c.body) AS proof,
               CASE WHEN a.body IS NOT NULL THEN 1 WHEN b.body IS NOT NULL THEN 2 WHEN c.body IS NOT NULL THEN 3 END AS match_tier
        FROM v_labelled p LEFT JOIN v_stored a ON a.issue_id = p.issue_id AND a.label = p.label
        LEFT JOIN v_stored b ON b.issue_id = p.issue_id AND lower(b.label) = lower(p.label)
        LEFT JOIN v_stored c ON c.issue_id = p.issue_id AND lower(c.label) = 'page ' || p.page_no""", _STORED),
    "proof_upsert": compose(_FULL.format("s.body, n.body", ""), _STORED),
    "proof_replace": compose(_FULL.format("n.body, s.body", " WHERE proofed"), _STORED),
    "overrides": compose(f"""
        SELECT issue_id, page_no, line_no - 1 AS chunk_no, text, false AS proofed, NULL::BOOLEAN AS skip_flag FROM v_lines
        WHERE page_no % 3 <> 0
        UNION ALL
        SELECT issue_id, page_no, generate_subscripts(ps, 1) - 1, unnest(ps), true, flag
        FROM (SELECT issue_id, page_no, CASE WHEN page_no % 9 = 0 THEN true END AS flag,
                     list_filter(list_transform(regexp_split_to_array(arg_max(body, version), '\\n\\s*\\n'),
                       lambda p: {strip('p')}), lambda p: p <> '') AS ps
              FROM v_proofs GROUP BY issue_id, page_no)"""),
    "progress": compose("""
        SELECT issue_id, count(*) AS pages, count(s.body) AS attempted, count(*) FILTER (WHERE s.body <> '') AS proofed,
               count(s.body) = count(*) AS done
        FROM (SELECT issue_id, lower(label) AS low FROM v_issue_pages) p
        LEFT JOIN (SELECT issue_id, lower(label) AS low, body FROM v_stored) s USING (issue_id, low)
        GROUP BY issue_id""", _STORED),
    "triage": compose(f"""
        SELECT issue_id, page_no, reason, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0,
               CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1
        FROM (SELECT *, reason = 'noisy_lines' AND x1 - x0 > 30 AND y1 - y0 > 20 AS ok FROM (
          SELECT p.issue_id, p.page_no, CASE WHEN s.n IS NULL THEN 'no_lines' WHEN p.page_no = 1 THEN 'first'
                 WHEN words < 15 THEN 'few_words' WHEN words < 100 AND bangs >= 3 THEN 'bangs'
                 WHEN tiny::DOUBLE / words > 0.5 THEN 'tiny_words' WHEN alnum::DOUBLE / len < 0.5 THEN 'low_alnum'
                 WHEN any_noisy THEN 'noisy_lines' END AS reason,
                 greatest(0, bx0 - 35) AS x0, greatest(0, by0 - 60) AS y0, least(800, bx1 + 35) AS x1, least(1100, by1 + 60) AS y1
          FROM v_issue_pages p LEFT JOIN v_tri2 s USING (issue_id, page_no)) WHERE reason IS NOT NULL)""", {
        "v_tri0": r"""
            SELECT *, length(text) > 10 AND (len(regexp_extract_all(text, '[<>~;=_`|/{}\\\[\]"^]'))::DOUBLE / length(text) > 0.07
                 OR len(regexp_extract_all(text, '[\p{L}\p{N}]'))::DOUBLE / length(text) < 0.6) AS noisy
            FROM v_ocr_lines WHERE page_no % 19 <> 0""",
        "v_tri1": """
            SELECT *, noisy OR coalesce(lag(noisy) OVER w AND top - lag(top + height) OVER w
                     BETWEEN 0 AND 2.5 * greatest(1, lag(height) OVER w), false) AS blk
            FROM v_tri0 WINDOW w AS (PARTITION BY issue_id, page_no ORDER BY line_no)""",
        "v_tri2": r"""
            SELECT issue_id, page_no, count(*) AS n, sum(len(regexp_extract_all(text, '\S+'))) AS words,
                   sum(len(list_filter(regexp_extract_all(text, '\S+'), lambda w: length(w) <= 2))) AS tiny,
                   sum(len(regexp_extract_all(text, '!'))) AS bangs,
                   sum(len(regexp_extract_all(text, '[\p{L}\p{N}]'))) AS alnum, sum(length(text)) + count(*) - 1 AS len,
                   bool_or(noisy) AS any_noisy, min("left") FILTER (WHERE blk) AS bx0, min(top) FILTER (WHERE blk) AS by0,
                   max("left" + width) FILTER (WHERE blk) AS bx1, max(top + height) FILTER (WHERE blk) AS by1
            FROM v_tri1 GROUP BY issue_id, page_no""",
    }),
}

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z0-9äöåà-ÿ]{{3,}}$')))"
_TAGLESS = strip("regexp_replace(b, '^" + chr(92) + "s*" + chr(92) + "[" + chr(92) + "[SKIP_AS_AD" + chr(92) + "]" + chr(92) + "]', '')")
_ANCHOR = {
    "v_anc_body": f"""
        SELECT issue_id, page_no, {Q.repair_core(_TAGLESS)} AS body
        FROM (SELECT issue_id, page_no, {strip('arg_max(body, version)')} AS b FROM v_proofs GROUP BY issue_id, page_no)""",
    "v_anc_parts": f"""
        SELECT issue_id, page_no, CASE WHEN len(ps) > 0 THEN ps ELSE [body] END AS ps FROM (
            SELECT *, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: {strip('p')}),
                                  lambda p: p <> '') AS ps FROM v_anc_body)""",
    "v_anc_text": f"""
        SELECT issue_id, page_no, para_no, {Q.dehyphenate('p')} AS text
        FROM (SELECT issue_id, page_no, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS para_no FROM v_anc_parts)""",
    "v_anc_para": f"SELECT *, {_TOKENS.format('text')} AS ts FROM v_anc_text",
    "v_anc_line": f"""
        SELECT issue_id, page_no, row_number() OVER (PARTITION BY issue_id, page_no ORDER BY line_no) - 1 AS pos, "left" AS x,
               top AS y, width AS w, height AS h, {_TOKENS.format('text')} AS ts
        FROM v_lines WHERE width > 0 AND height > 0""",
    "v_anc_page": """
        SELECT issue_id, page_no, count(*) AS n, list({'x': x, 'y': y, 'w': w, 'h': h} ORDER BY pos) AS boxes
        FROM v_anc_line GROUP BY issue_id, page_no""",
    "v_anc_hit": """
        SELECT p.issue_id, p.page_no, p.para_no, p.token, l.pos, x, y, w, h
        FROM (SELECT issue_id, page_no, para_no, unnest(ts) AS token FROM v_anc_para) p
        JOIN (SELECT issue_id, page_no, pos, x, y, w, h, unnest(ts) AS token FROM v_anc_line) l USING (issue_id, page_no, token)""",
    "v_anc_span": """
        SELECT issue_id, page_no, para_no, begin, count(DISTINCT token) AS shared, max(pos) AS last, min(x) AS x0, min(y) AS y0,
               max(x + w) AS x1, max(y + h) AS y1
        FROM (SELECT *, unnest(generate_series(greatest(pos - 7, 0), pos)) AS begin FROM v_anc_hit)
        GROUP BY issue_id, page_no, para_no, begin HAVING count(DISTINCT token) >= 2""",
    "v_anc_spans": """
        SELECT issue_id, page_no, para_no, list({'k': -shared, 'b': begin, 'last': last, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) AS ss
        FROM v_anc_span GROUP BY issue_id, page_no, para_no""",
    "v_anc_all": """
        SELECT p.issue_id, p.page_no, para_no, len(ts) AS words, length(text) AS size, coalesce(ss, []) AS ss,
               coalesce(n, 0) AS n, boxes
        FROM v_anc_para p LEFT JOIN v_anc_spans USING (issue_id, page_no, para_no) LEFT JOIN v_anc_page USING (issue_id, page_no)""",
    "v_rec_anc": """
        SELECT issue_id, page_no, -1::BIGINT AS para_no, 0::BIGINT AS cur, NULL::BIGINT AS x, NULL::BIGINT AS y, NULL::BIGINT AS w,
               NULL::BIGINT AS h FROM v_anc_body
        UNION ALL
        SELECT issue_id, page_no, para_no, CASE WHEN b IS NULL THEN cur ELSE least(n - 1, b.last + 1) END,
               CASE WHEN b IS NOT NULL THEN b.x0 WHEN pw > 0 THEN px WHEN n > 0 THEN g.x ELSE 0 END,
               CASE WHEN b IS NOT NULL THEN b.y0 WHEN pw > 0 THEN least(py + ph + 8, 1060) WHEN n > 0 THEN g.y ELSE 0 END,
               CASE WHEN b IS NOT NULL THEN b.x1 - b.x0 WHEN pw > 0 THEN pw WHEN n > 0 THEN g.w ELSE 0 END,
               CASE WHEN b IS NOT NULL THEN b.y1 - b.y0 WHEN pw > 0 THEN greatest(24, least(120, size // 3)) WHEN n > 0 THEN g.h ELSE 0 END
        FROM (SELECT a.issue_id, a.page_no, a.para_no, a.n, a.size, r.cur, r.x AS px, r.y AS py, r.w AS pw, r.h AS ph,
                     a.boxes[least(r.cur, a.n - 1) + 1] AS g,
                     list_sort(list_filter(a.ss, lambda s: s.b >= r.cur AND s.b < least(a.n, r.cur + greatest(14, a.words // 2))))[1] AS b
              FROM v_rec_anc r JOIN v_anc_all a ON a.issue_id = r.issue_id AND a.page_no = r.page_no AND a.para_no = r.para_no + 1)""",
}
SQL["anchor_proofs"] = compose(
    """SELECT p.issue_id, p.page_no, p.para_no, p.text, r.x AS "left", r.y AS top, r.w AS width, r.h AS height
       FROM v_anc_text p JOIN v_rec_anc r USING (issue_id, page_no, para_no)""",
    _ANCHOR,
)
