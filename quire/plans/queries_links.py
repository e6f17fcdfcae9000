"""Registered queries over links, ads, contents pages, articles and playlists (E) and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.checks import sql_features as X
from quire.checks.sql_links import q
from quire.checks.sql_noise import NOISE_VIEWS
from quire.functions.sentences import sentences
from quire.operators import ads as A
from quire.operators import features as D
from quire.operators import links as L
from quire.operators import playlist as R
from quire.operators import repeats as N
from quire.operators import toc as T
from quire.operators.proofs import preferred_text
from quire.plans import views as V
from quire.session import materialize

KEY = ("issue_id", "page_no")
#: what the jobs of this module read of a page; the scores of the web profile are not computed for them
FEATURES = [
    *KEY, "label", "skip_flag", "pdf_no", "folio", "folio_list", "edge_folios", "continued_on", "continued_from", "title",
    "is_ad", "is_form", "is_body", "is_weak", "chars", "prose",
]


class Corpus:
    """Shared inputs of one query; features are written once where several jobs read them."""

    def __init__(self, spark: SparkSession, sf: str, keep: bool = False) -> None:
        self.pages = V.cue_pages(spark, sf)
        features = D.page_features(self.pages).select(FEATURES)
        self.features = materialize(features, "features") if keep else features
        self.offsets = L.offset_first(self.features)

    @property
    def chunks(self) -> DataFrame:
        lines = V.page_lines(self.pages)
        return lines.select(*KEY, (F.col("line_no") - 1).alias("chunk_no"), "text")

    def skips(self) -> DataFrame:
        return A.ad_skips(self.features, self.chunks, self.offsets)

    def runs(self) -> DataFrame:
        return A.ad_runs(self.features, self.skips())

    def links(self) -> DataFrame:
        return L.landing_chunk(L.landings(self.features, self.offsets), self.chunks)


def repeat_headers(spark: SparkSession, sf: str) -> DataFrame:
    return N.repeats(V.layout_lines(spark, sf)).select("issue_id", "zone", "norm", "n")


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    return N.tag_noise(V.layout_lines(spark, sf), document=F.concat("issue_id", F.lit(" de la.pdf")))


def noise_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _tagged(spark, sf).select(*KEY, "line_no", "is_noise", "noise_type")


def offset_first(spark: SparkSession, sf: str) -> DataFrame:
    return Corpus(spark, sf).offsets.select("issue_id", "page_offset", "evidence_page")


def offset_first_web(spark: SparkSession, sf: str) -> DataFrame:
    return L.offset_first(Corpus(spark, sf).features, profile="web").select(
        "issue_id", "page_offset", "evidence_page"
    )


def offset_vote(spark: SparkSession, sf: str) -> DataFrame:
    return L.offset_vote(Corpus(spark, sf).features).select(
        "issue_id", "page_offset", "votes", "evidence_page", "confirmed"
    )


def landings(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    return c.links().select("issue_id", "src_page", "target", "source", "tier", "dst_page", "dst_chunk")


def landings_web(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    return L.landings(c.features, c.offsets, "web").select("issue_id", "src_page", "target", "tier", "dst_page")


def landings_cue_first(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    return L.landings(c.features, c.offsets, "cue_first").select("issue_id", "src_page", "target", "tier", "dst_page")


def goto_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    out = L.resolve_goto(V.requests(spark, sf).drop("ts"), c.features, c.offsets)
    return out.select("request_id", "issue_id", "number", "status", "tier", "dst_page")


def start_check(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.issue_pages(spark, sf).select(*KEY, "label")
    k = F.regexp_extract("issue_id", r"(\d+)", 1).cast("int")
    loaded = pages.filter(F.col("page_no") >= k % 5 + 1)
    requested = pages.select("issue_id").distinct().withColumn("requested", k % 4 + 1)
    return L.check_start(loaded, requested).select("issue_id", "requested", "label", "actual")


def ad_skips(spark: SparkSession, sf: str) -> DataFrame:
    return Corpus(spark, sf, keep=True).skips().select("issue_id", "src_page", "ad_page", "dst_page", "source")


def ad_runs(spark: SparkSession, sf: str) -> DataFrame:
    return Corpus(spark, sf, keep=True).runs()


def ad_queue(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    return A.ad_queue(c.features, c.runs(), c.offsets)


def page_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    return L.page_edges(c.features, c.runs(), c.offsets)


def _articles(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages by piece, pieces of each article, article of each start) of all pages of all issues."""
    runs = materialize(c.runs(), "runs")
    placed, reach = L.article_segments(c.features, L.page_edges(c.features, runs, c.offsets), runs)
    return placed, reach, materialize(L.article_starts(c.features, placed, reach), "starts")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Page runs of every article of every issue."""
    placed, reach, starts = _articles(Corpus(spark, sf, keep=True))
    return L.article_runs(placed, reach, starts)


def article_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The article of every page of every issue."""
    return _articles(Corpus(spark, sf, keep=True))[2].select("issue_id", "start_page", "article")


def article_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Text of every article of every issue, proofread where it is."""
    c = Corpus(spark, sf, keep=True)
    placed, reach, starts = _articles(c)
    pages = L.article_lists(placed, reach, starts)
    path = F.concat(F.lit("/scans/BYTE_1976-08_"), F.col("issue_id"), F.lit("/scan.pdf"))
    texts = preferred_text(c.pages.select(*KEY, "label", "raw_text"), V.proofs(spark, sf))
    out = L.export_articles(pages.withColumnRenamed("article", "start_page"), c.features, texts, path, part_bytes=20_000)
    return out.select("issue_id", "start_page", "part", "file_name", "dump")


def article_walk(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    starts = c.features.filter(F.size("continued_on") > 0).select("issue_id", F.col("page_no").alias("start_page"))
    return L.first_target_walk(c.features, starts)


def toc_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.issue_pages(spark, sf)
    text = (
        F.when(F.col("page_no") % 10 == 3, F.concat(F.lit("Contents\n"), F.col("raw_text")))
        .when(F.col("page_no") % 10 == 4, F.concat(F.lit("News in this Issue\n"), F.col("raw_text")))
        .otherwise(F.col("raw_text"))
    )
    titled = D.titles(pages.withColumn("raw_text", text))
    return titled.select(*KEY, D.toc_flag(F.col("title"), F.col("raw_text")).alias("is_toc"))


def _toc_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = Corpus(spark, sf, keep=True)
    titles = c.features.select(*KEY, "title", "skip_flag")
    return V.toc_texts(titles), titles


def toc_index(spark: SparkSession, sf: str) -> DataFrame:
    toc, titles = _toc_inputs(spark, sf)
    return T.toc_index(toc, titles).select(*KEY, "toc_page", "title")


def toc_links(spark: SparkSession, sf: str) -> DataFrame:
    toc, titles = _toc_inputs(spark, sf)
    chunks = toc.select(*KEY, F.posexplode(F.split("raw_text", "\n")).alias("chunk_no", "text")).withColumn(
        "is_noise", F.lit(False)
    )
    return T.toc_links(chunks, titles)


def playlist(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, keep=True)
    runs = materialize(c.runs(), "runs")
    steps = materialize(R.next_pages(c.features, c.links(), runs), "steps")
    order = R.entry_chunks(R.page_order(steps), steps)
    spoken = sentences(c.chunks)
    noise = _tagged(spark, sf).filter("is_noise").select(*KEY, (F.col("line_no") - 1).alias("chunk_no"))
    return R.playlist(spoken, order, noise)


QUERIES = {
    "repeat_headers": repeat_headers,
    "noise_tags": noise_tags,
    "offset_first": offset_first,
    "offset_first_web": offset_first_web,
    "offset_vote": offset_vote,
    "landings": landings,
    "landings_web": landings_web,
    "landings_cue_first": landings_cue_first,
    "goto_pages": goto_pages,
    "start_check": start_check,
    "ad_skips": ad_skips,
    "ad_runs": ad_runs,
    "ad_queue": ad_queue,
    "page_edges": page_edges,
    "articles": articles,
    "article_starts": article_starts,
    "article_dump": article_dump,
    "article_walk": article_walk,
    "toc_pages": toc_pages,
    "toc_index": toc_index,
    "toc_links": toc_links,
    "playlist": playlist,
}

_LAND = """
    SELECT r.issue_id, r.src_page, r.target, coalesce(d.t1, d.t2, d.t3{t4}) AS dst_page,
           CASE WHEN d.t1 IS NOT NULL THEN 1 WHEN d.t2 IS NOT NULL THEN 2 WHEN d.t3 IS NOT NULL THEN 3 {c4} END AS tier
    FROM v_cue_req r LEFT JOIN LATERAL (SELECT {cols} FROM v_feat p WHERE p.issue_id = r.issue_id) d ON true"""
_T = "min(page_no) FILTER (WHERE {}) AS {}"
_LABEL = "pdf_no = r.target + r.off"
_FROM = "list_contains(cfrom, r.source)"
_EDGE = "list_contains(edges, r.target)"

SQL = {
    "repeat_headers": q("SELECT issue_id, zone, norm, n FROM v_repeats", NOISE_VIEWS),
    "noise_tags": q(
        "SELECT issue_id, page_no, line_no, noise_type IS NOT NULL AS is_noise, noise_type FROM v_tagged", NOISE_VIEWS
    ),
    "offset_first": q("SELECT issue_id, off AS page_offset, evidence AS evidence_page FROM v_off"),
    "offset_first_web": q("""
        SELECT issue_id, coalesce(arg_min(o, page_no), 0) AS page_offset, min(page_no) FILTER (WHERE o IS NOT NULL)
                 AS evidence_page
        FROM (SELECT issue_id, page_no, list_filter(list_transform(list_filter(ls,
                  lambda s: regexp_matches(s, '^\\s*(?:[—\\-–~•·*]+\\s*)?(\\d{1,4})(?:\\s*[—\\-–~•·*]+)?\\s*$')),
                  lambda s: page_no - CAST(regexp_extract(s, '(\\d{1,4})', 1) AS INT)), lambda o: abs(o) <= 15)[1] AS o
              FROM v_feat0) GROUP BY issue_id"""),
    "landings": q("SELECT issue_id, src_page, target, source, tier, dst_page, dst_chunk FROM v_land_c"),
    "landings_web": q(_LAND.format(t4="", c4="", cols=", ".join([
        _T.format("pdf_no = r.target + r.off OR pdf_no = r.target", "t1"), _T.format(_FROM, "t2"),
        _T.format(_EDGE, "t3")]))),
    "landings_cue_first": q(_LAND.format(t4=", d.t4", c4="WHEN d.t4 IS NOT NULL THEN 4", cols=", ".join([
        _T.format(_FROM, "t1"), _T.format(_LABEL, "t2"), _T.format("len(cfrom) > 0 AND " + _EDGE, "t3"),
        _T.format(_EDGE, "t4")]))),
    "goto_pages": q("""
        SELECT r.request_id, r.issue_id, r.number, coalesce(t1, t2, t3) AS dst_page,
               CASE WHEN coalesce(t1, t2, t3) IS NULL THEN 'not found' ELSE 'found' END AS status,
               CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 END AS tier
        FROM v_requests r JOIN (
            SELECT d.issue_id, d.number, min(page_no) FILTER (WHERE pdf_no = d.number + off) AS t1,
                   min(page_no) FILTER (WHERE list_contains(edges, d.number)) AS t2,
                   min(page_no) FILTER (WHERE off = 0 AND page_no = d.number) AS t3
            FROM (SELECT DISTINCT issue_id, number FROM v_requests) d LEFT JOIN v_fo p ON p.issue_id = d.issue_id
            GROUP BY ALL) a USING (issue_id, number)"""),
    "start_check": q("""
        SELECT issue_id, requested, label, actual FROM (
          SELECT issue_id, CAST(regexp_extract(issue_id, '(\\d+)', 1) AS INT) % 4 + 1 AS requested,
                 arg_min(label, page_no) AS label, min(page_no) AS actual
          FROM v_issue_pages WHERE page_no >= CAST(regexp_extract(issue_id, '(\\d+)', 1) AS INT) % 5 + 1
          GROUP BY issue_id) WHERE requested > 1 AND actual <> requested"""),
    "ad_skips": q("SELECT issue_id, src_page, ad_page, dst_page, source FROM v_skips"),
    "ad_runs": q("SELECT issue_id, page_no, run_page, resume_page FROM v_runs"),
    "ad_queue": q("""
        SELECT f.issue_id, f.page_no, r.page_no IS NOT NULL AS skipped, greatest(0, f.pdf_no - f.off) AS printed
        FROM v_fo f LEFT JOIN v_runs r ON r.issue_id = f.issue_id AND r.page_no = f.page_no
        WHERE f.is_ad OR f.is_form OR r.page_no IS NOT NULL"""),
    "page_edges": q("SELECT issue_id, src, dst, kind FROM v_edges"),
    "articles": q("""
        SELECT issue_id, article, min(page_no) AS first_page, max(page_no) AS last_page
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY issue_id, article ORDER BY pos) AS g FROM v_article_pages)
        GROUP BY issue_id, article, g"""),
    "article_starts": q("SELECT issue_id, start_page, article FROM v_article_of"),
    "article_dump": q(f"""
        SELECT a.issue_id, a.article AS start_page, part,
               any_value(CASE WHEN length(stem) > 80 THEN rtrim(stem[1:79], ' .') || '…' ELSE stem END
                         || ' - 1976-08.txt') AS file_name,
               {X.strip("string_agg(section, chr(10) ORDER BY a.page_no)")} || chr(10) AS dump
        FROM v_article_parts a
        JOIN (SELECT m.issue_id, m.article, trim(regexp_replace(regexp_replace(
                 CASE WHEN is_ad AND (title IS NULL OR length(title) > 60 OR prefix(lower(title), 'continued'))
                           THEN 'Ad p.' || f.page_no
                      WHEN title IS NULL THEN 'Article p.' || f.page_no ELSE title END,
                 '[<>:"/\\\\|?*\\x00-\\x1f]+', '', 'g'), '\\s+', ' ', 'g'), ' .') AS stem
              FROM (SELECT issue_id, article, min(page_no) AS lead FROM v_article_pages GROUP BY ALL) m
              JOIN v_feat f ON f.issue_id = m.issue_id AND f.page_no = m.lead) n
          ON n.issue_id = a.issue_id AND n.article = a.article
        GROUP BY a.issue_id, a.article, part""", {
        "v_preferred": """
            SELECT c.issue_id, c.page_no, c.label, coalesce(nullif(p.body, ''), raw_text) AS t FROM v_cue_pages c
            LEFT JOIN (SELECT issue_id, page_no, arg_max(body, version) AS body FROM v_proofs GROUP BY ALL) p USING (issue_id, page_no)""",
        "v_article_sections": f"""
            SELECT a.issue_id, a.article, a.page_no, '=== ' || label || ' ===' || chr(10) ||
                   CASE WHEN {X.strip('t')} = '' THEN '' ELSE {X.strip('t')} || chr(10) END AS section
            FROM v_article_pages a JOIN v_preferred USING (issue_id, page_no)""",
        "v_article_parts": """
            SELECT *, ((sum(octet_length(encode(section)) + 1) OVER (PARTITION BY issue_id, article ORDER BY page_no)
                        - octet_length(encode(section)) - 1) // 20000)::INT AS part FROM v_article_sections""",
    }),
    "article_walk": q("SELECT issue_id, start_page, ord, page_no FROM v_rec_steps", {
        "v_rec_steps": """
            SELECT issue_id, page_no AS start_page, 0 AS ord, page_no, [page_no] AS visited
            FROM v_feat WHERE len(con) > 0
            UNION ALL
            SELECT w.issue_id, w.start_page, w.ord + 1, p.page_no, list_append(w.visited, p.page_no)
            FROM v_rec_steps w JOIN v_feat0 f ON f.issue_id = w.issue_id AND f.page_no = w.page_no AND len(f.con) > 0
            JOIN LATERAL (SELECT min(g.page_no) AS page_no FROM v_feat0 g
                          WHERE g.issue_id = w.issue_id AND NOT list_contains(w.visited, g.page_no)
                            AND (len(g.cfrom) > 0 OR contains(g.label, CAST(f.con[1] AS VARCHAR)))) p ON true
            WHERE p.page_no IS NOT NULL"""}),
    "toc_index": q("""
        SELECT t.issue_id, t.page_no, max(c.page_no) AS toc_page, any_value(t.title) AS title
        FROM v_linkable t JOIN v_toc c ON c.issue_id = t.issue_id AND c.page_no <> t.page_no
             AND contains(lower(c.raw_text), t.low)
        GROUP BY t.issue_id, t.page_no"""),
    "toc_links": q("""
        SELECT issue_id, toc_page, chunk_no, min(page_no) AS dst_page, arg_min(tier, page_no * 10 + tier) AS tier
        FROM v_toc_hits GROUP BY ALL"""),
    "playlist": q("""
        SELECT issue_id, play_seq, page_no, chunk_no, sent_no, text,
               CASE WHEN play_seq > 1 THEN play_seq - 1 END AS prev_sentence,
               min(play_seq) OVER c AS chunk_start, max(play_seq) OVER c + 1 AS next_chunk_at,
               min(play_seq) OVER p AS page_start, max(play_seq) OVER p + 1 AS next_page_at
        FROM v_play WINDOW c AS (PARTITION BY issue_id, page_no, chunk_no), p AS (PARTITION BY issue_id, page_no)""",
        NOISE_VIEWS | {
            "v_play0": """
                SELECT issue_id, page_no, line_no - 1 AS chunk_no, list_filter(list_transform(string_split(
                   regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'),
                     '([.!?…])\\s+(["''“‘(\\[]?[A-ZÀ-ÖÅ0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
                   lambda s: trim(s)), lambda s: s <> '') AS ss
                FROM v_page_lines0 l WHERE NOT EXISTS (SELECT 1 FROM v_tagged t WHERE t.noise_type IS NOT NULL
                  AND (t.issue_id, t.page_no, t.line_no) = (l.issue_id, l.page_no, l.line_no))""",
            "v_play1": """
                SELECT issue_id, page_no, chunk_no, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS sent_no
                FROM v_play0""",
            "v_play": """
                SELECT s.*, row_number() OVER (PARTITION BY s.issue_id ORDER BY o.pos, chunk_no, sent_no) AS play_seq
                FROM v_play1 s JOIN v_play_order o USING (issue_id, page_no) WHERE chunk_no >= first_chunk""",
        }),
}

SQL["offset_vote"] = q("""
    SELECT i.issue_id, coalesce(b.o, 0) AS page_offset, coalesce(b.n, 0) AS votes, b.f AS evidence_page,
           coalesce(b.n, 0) >= 2 AS confirmed
    FROM (SELECT DISTINCT issue_id FROM v_feat) i LEFT JOIN v_vote b USING (issue_id)""", {
    "v_vote0": """SELECT issue_id, pdf_no - folio AS o, count(*) AS n, min(page_no) AS f FROM v_feat
                  WHERE abs(pdf_no - folio) <= 10 GROUP BY 1, 2""",
    "v_vote": "SELECT * FROM v_vote0 QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY n DESC, f) = 1",
})
SQL["toc_pages"] = q("""
    SELECT issue_id, page_no,
           regexp_matches(lower(coalesce(title, '') || ' ' || raw_text[1:400]),
                          'in the queue|table of contents|in this issue')
           OR coalesce(regexp_matches(title, '(?i)\\b(?:table\\s+of\\s+)?contents\\b'), false)
           OR regexp_matches(raw_text[1:300], '(?i)(?:^|\\n)\\s*contents\\s*(?:\\n|$)') AS is_toc
    FROM v_cue_pages JOIN v_titles_all USING (issue_id, page_no)""", {
    "v_cue_pages": """SELECT issue_id, page_no, n, 0 AS k, label, CASE WHEN page_no % 10 = 3 THEN 'Contents' || chr(10) || raw_text
        WHEN page_no % 10 = 4 THEN 'News in this Issue' || chr(10) || raw_text ELSE raw_text END AS raw_text
        FROM v_issue_pages""",
    "v_titles_all": """SELECT p.issue_id, p.page_no, title FROM v_feat0 p LEFT JOIN v_titles USING (issue_id, page_no)""",
})
