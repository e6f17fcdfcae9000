"""Registered queries over sources and sinks (A) and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.checks import sql_clean as Q
from quire.checks.sql_features import cnt, rx, strip
from quire.checks.sql_layout import PAGE, join_fold
from quire.checks.sql_layout import q as layout_q
from quire.checks.sql_views import compose, lit
from quire.functions import patterns as P
from quire.functions import scores as S
from quire.functions.entities import decoded
from quire.functions.pagination import PAGE_MARKER
from quire.functions.rtf import rtf_pages
from quire.plans import views as V
from quire.sources import documents as A
from quire.sources import images as I
from quire.sources import lines as L
from quire.sources import page_dump as D

KEY = ("issue_id", "page_no")
BOX = ("left", "top", "width", "height")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with paragraph breaks after every second line; some carry form feeds or page markers."""
    text = F.regexp_replace("text", r"(?m)^([^\n]*\n[^\n]*)\n", "$1\n\n")
    marked = (
        F.when(F.col("doc_id") % 17 == 3, F.replace(text, F.lit("\n\n"), F.lit("\f")))
        .when(F.col("doc_id") % 17 == 5, F.concat(F.lit("=== Page 1 ===\n"), text, F.lit("\n--- page II ---\nend")))
        .otherwise(text)
    )
    return V.table(spark, sf, "documents").select(
        "doc_id", marked.alias("text"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title")
    )


def paginate_words(spark: SparkSession, sf: str) -> DataFrame:
    return A.paginate(_docs(spark, sf), ["doc_id"])


def paragraph_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return A.layout_paragraphs(_docs(spark, sf), ["doc_id"]).select("doc_id", "line_no", "text", *BOX)


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown: headings, emphasis, links, lists, code and quotes around their lines."""
    d = F.col("doc_id").cast("string")
    body = F.regexp_replace("text", r"\n", "\n\n* item\n1. step ")
    many = F.concat(
        F.lit("# Book "), d, F.lit("\n\nIntro **bold** and _soft_ [link](http://x.y/z) ![pic](a.png)\n\n## Part one\n"),
        body, F.lit("\n\n```py\ncode here\n```\n> quoted `inline`\n\n---\n### Deep\nend <b>tag</b>"),
    )
    single = F.concat(F.lit("Plain *note* "), body)
    return V.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, single).otherwise(many).alias("text"),
        F.concat(F.lit("note "), d).alias("title"),
    )


def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    return A.ingest_markdown(_markdown(spark, sf), ["doc_id"])


def rtf_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as rich text and read back; every second one has a page break at its first line break."""
    text = F.col("text")
    for char, written in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("é", "\\'e9"), ("ü", "\\u252?"), ("ß", "\\u223 ?"), ("•", "\\bullet ")):
        text = F.replace(text, F.lit(char), F.lit(written))
    text = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(text, r"\A([^\n]*)\n", r"$1\\page ")).otherwise(text)
    head = r"{\rtf1\ansi{\fonttbl{\f0 Times;}{\f1 {\*\falt x}Arial;}}{\*\generator g;}{\info{\title T}}\f0\fs24 {\b "
    rich = F.concat(F.lit(head), F.replace(text, F.lit("\n"), F.lit("\\par\r ")), F.lit("}\\par }"))
    docs = V.table(spark, sf, "documents").select("doc_id", rtf_pages(rich).alias("p"))
    return docs.select("doc_id", F.posexplode("p").alias("page", "text")).select("doc_id", (F.col("page") + 1).alias("page_no"), "text")


def entity_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written with character references of all kinds, read back; text that looks like a reference is kept."""
    text = F.replace(F.replace(F.concat(F.lit("&lt; "), "text"), F.lit("&"), F.lit("\x01")), F.lit(";"), F.lit("\x02"))
    for char, written in (("é", "&eacute;"), ("ü", "&uuml"), ("ê", "&#234;"), ("è", "&#xE8;"), ("ç", "&ccedil"), ("ö", "&#x00F6;"), ("\x01", "&amp;"), ("\x02", "&semi;")):
        text = F.replace(text, F.lit(char), F.lit(written))
    return V.table(spark, sf, "documents").select("doc_id", decoded(text).alias("text"))


def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    return A.ingest_html(V.table(spark, sf, "pages"), ["page_id"])


def _subtitles(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as subtitle cues in turn order."""
    cue = F.concat(
        (F.col("turn") + 1).cast("string"), F.lit("\n00:00:0"), F.col("turn").cast("string"),
        F.lit(",000 --> 00:00:09,000\n<i>"), F.col("role"), F.lit("</i>\n"), F.col("text"), F.lit("\n\n"),
    )
    return (
        V.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("_c"))
        .select(
            "conv_id",
            F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("_c", lambda e: e["cue"]), "")).alias("text"),
            F.lit("talk").alias("title"),
        )
    )


def subtitle_pages(spark: SparkSession, sf: str) -> DataFrame:
    return A.ingest_subtitles(_subtitles(spark, sf), ["conv_id"])


def transcript_pages(spark: SparkSession, sf: str) -> DataFrame:
    return A.ingest_json(V.transcripts(spark, sf).withColumn("title", F.lit("talk")), ["conv_id"])


def _delimited(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    first = F.regexp_replace("text", "[\n,\"']", " ")
    return V.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("id,,\"lang\"\n"), d, F.lit(","), first, F.lit(",'"), F.col("lang"), F.lit("'\n\n,x,y,"), d).alias("text"),
        F.lit("table").alias("title"),
    )


def delimited_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.ingest_delimited(_delimited(spark, sf), ["doc_id"])


def ingest_all(spark: SparkSession, sf: str) -> DataFrame:
    """All formats in one table of files: Markdown, delimited, plain text and HTML, routed by extension."""

    def named(df: DataFrame, key: str, ext: str, text: str) -> DataFrame:
        path = F.concat(F.lit("/in/"), F.lit(ext), F.lit("/file_"), F.col(key).cast("string"), F.lit("." + ext))
        return df.select(path.alias("path"), F.col(text).alias("content"))

    files = (
        named(_markdown(spark, sf), "doc_id", "md", "text")
        .unionByName(named(_delimited(spark, sf), "doc_id", "csv", "text"))
        .unionByName(named(_docs(spark, sf), "doc_id", "txt", "text"))
        .unionByName(named(_subtitles(spark, sf), "conv_id", "srt", "text"))
        .unionByName(named(V.transcripts(spark, sf), "conv_id", "json", "json"))
        .unionByName(named(V.table(spark, sf, "pages"), "page_id", "html", "html"))
    )
    return A.route_documents(files)


def page_dump(spark: SparkSession, sf: str) -> DataFrame:
    return D.read_dump(V.dumps(spark, sf), ["issue_id", "file_no"])


def page_dump_text(spark: SparkSession, sf: str) -> DataFrame:
    return V.dumps(spark, sf)


def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.assemble_lines(V.words(spark, sf))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    words = V.words(spark, sf).filter("level = 5")
    return words.select(
        *KEY,
        (F.col("block_num") * 100000 + F.col("line_num") * 1000 + F.col("word_no")).alias("span_no"),
        "text",
        F.col("left").alias("x0"),
        (F.col("left") + F.col("width")).alias("x1"),
        F.col("top").alias("y0"),
        (F.col("top") + F.col("height")).alias("y1"),
        F.col("height").alias("font"),
    )


def span_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.assemble_spans(_spans(spark, sf))


def span_blocks(spark: SparkSession, sf: str) -> DataFrame:
    words = V.words(spark, sf).filter("level = 5")
    fragments = words.select(
        *KEY,
        F.col("block_num").alias("block_no"),
        F.col("line_num").alias("line_no"),
        F.col("word_no").alias("span_no"),
        "text",
        F.col("left").alias("x0"),
        F.col("top").alias("y0"),
        (F.col("left") + F.col("width")).alias("x1"),
        (F.col("top") + F.col("height")).alias("y1"),
    )
    return L.assemble_blocks(fragments, dpi=144)


def image_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Image names derived from the documents, one folder per source."""
    names = V.table(spark, sf, "documents").select(
        F.concat(
            F.lit("/scan/"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "/Page_").otherwise("/page_"),
            F.md5(F.col("doc_id").cast("string")),
            F.element_at(F.array(*[F.lit(e) for e in (".PNG", ".jpg", ".txt", ".Tiff")]), (F.col("doc_id") % 4 + 1).cast("int")),
        ).alias("path")
    )
    return I.number_images(names).select("folder", "name", "seq", "n_seq", "label")


def page_range(spark: SparkSession, sf: str) -> DataFrame:
    return L.page_range(V.issue_pages(spark, sf), 11, 20, offset=2).select(*KEY, "label")


def source_merge(spark: SparkSession, sf: str) -> DataFrame:
    # both readings are cut from pages dealt by their key, so neither is shuffled
    lines = V.positioned(V.pages_by_key(spark, sf))
    return L.merge_sources(lines, V.damaged(lines), "merge").select(
        *KEY, "line_no", "text", *BOX, "source_kind"
    )


def source_prefer(spark: SparkSession, sf: str) -> DataFrame:
    text = V.layout_lines(spark, sf).filter("page_no % 3 <> 0")
    return L.merge_sources(text, V.ocr_lines(spark, sf), "prefer").select(*KEY, "line_no", "text", "source_kind")


def merge_audit(spark: SparkSession, sf: str) -> DataFrame:
    return L.merge_audit(V.layout_lines(spark, sf), V.ocr_lines(spark, sf))


def word_quality(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.ocr_lines(spark, sf)
    total = F.aggregate(
        F.transform(F.split(F.trim("text"), r"\s+"), S.word_score), F.lit(0.0), lambda a, x: a + x
    )
    return lines.select(*KEY, "line_no", F.round(total, 6).alias("score"), S.junk_text(F.col("text")).alias("is_junk"))


QUERIES = {
    "paginate_words": paginate_words,
    "paragraph_boxes": paragraph_boxes,
    "markdown_sections": markdown_sections,
    "html_sections": html_sections,
    "entity_text": entity_text,
    "rtf_text": rtf_text,
    "subtitle_pages": subtitle_pages,
    "transcript_pages": transcript_pages,
    "delimited_rows": delimited_rows,
    "ingest_all": ingest_all,
    "page_dump": page_dump,
    "page_dump_text": page_dump_text,
    "word_lines": word_lines,
    "span_lines": span_lines,
    "span_blocks": span_blocks,
    "image_catalog": image_catalog,
    "page_range": page_range,
    "source_prefer": source_prefer,
    "source_merge": source_merge,
    "merge_audit": merge_audit,
    "word_quality": word_quality,
}

# --- checks -------------------------------------------------------------------------------------------------------------


def paged(source: str, key: str, text: str = "t", title: str = "title") -> dict[str, str]:
    """Views that paginate ``source(key, t, title)``; the last one is ``v_paged``."""
    parts = lambda p: f"list_filter(list_transform(regexp_split_to_array(t, {lit(p)}), lambda p: {strip('p')}), lambda p: p <> '')"
    return {
        "v_pg0": f"SELECT {key}, {text} AS t, {title} AS title FROM {source}",
        "v_pg1": f"""
            SELECT {key}, t, title, {parts(chr(12))} AS ff, {parts(PAGE_MARKER)} AS mk, {parts(chr(10) + '\\s*' + chr(10))} AS ps
            FROM v_pg0""",
        "v_pg2": f"""
            SELECT *, CASE WHEN {strip('t')} = '' THEN 'empty' WHEN contains(t, chr(12)) AND len(ff) > 1 THEN 'feed'
                WHEN {rx('t', PAGE_MARKER)} AND len(mk) > 0 THEN 'marker'
                WHEN len(ps) <= 4 AND length(t) < 2500 THEN 'single' ELSE 'fill' END AS rule FROM v_pg1""",
        "v_pg3": f"""
            SELECT {key}, title, ps, list_reduce(list_transform(ps, lambda p, i:
                     {{'w': len(regexp_split_to_array(p, '\\s+')), 's': [i]}}),
                   lambda a, x: CASE WHEN a.w + x.w > 380 THEN {{'w': x.w, 's': list_concat(a.s, x.s)}}
                                     ELSE {{'w': a.w + x.w, 's': a.s}} END).s AS st
            FROM v_pg2 WHERE rule = 'fill'""",
        "v_paged": f"""
            SELECT {key}, 1 AS page_no, title, CASE WHEN rule = 'empty' THEN '' ELSE {strip('t')} END AS text
            FROM v_pg2 WHERE rule IN ('empty', 'single')
            UNION ALL
            SELECT {key}, i, title || CASE WHEN rule = 'feed' THEN ' · Part ' ELSE ' · Page ' END || i, x
            FROM (SELECT {key}, rule, title, unnest(l) AS x, generate_subscripts(l, 1) AS i
                  FROM (SELECT *, CASE WHEN rule = 'feed' THEN ff ELSE mk END AS l FROM v_pg2
                        WHERE rule IN ('feed', 'marker')))
            UNION ALL
            SELECT {key}, i, title || ' · Page ' || i, array_to_string(ps[st[i]:coalesce(st[i + 1], len(ps) + 1) - 1],
                   chr(10) || chr(10))
            FROM (SELECT *, unnest(generate_series(1, len(st))) AS i FROM v_pg3)""",
    }


def _paged_sql(views: dict[str, str], source: str, key: str) -> str:
    return compose(f"SELECT {key}, page_no, title, text FROM v_paged", {**views, **paged(source, key)})


_DOCS = {
    "v_docs0": r"""SELECT doc_id, regexp_replace(text, '(?m)^([^\n]*\n[^\n]*)\n', '\1' || chr(10) || chr(10), 'g') AS x
                   FROM documents""",
    "v_docs": """
        SELECT doc_id, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 17 = 3 THEN replace(x, chr(10) || chr(10), chr(12))
            WHEN doc_id % 17 = 5 THEN '=== Page 1 ===' || chr(10) || x || chr(10) || '--- page II ---' || chr(10) || 'end'
            ELSE x END AS t FROM v_docs0""",
}


def _plain_md(t: str) -> str:
    t = Q.sub(t, r"<[^>]*>", " ")
    t = Q.sub(Q.sub(t, r"!\[([^\]]*)\]\([^)]*\)", ""), r"\[([^\]]+)\]\([^)]+\)", r"\1")
    t = Q.sub(t, r"(?s)```[a-zA-Z0-9_-]*\n?(.*?)```", r"\1")
    t = Q.sub(t, r"`([^`]+)`", r"\1")
    t = Q.sub(
        t,
        r"\*\*\*([^*_]+)\*\*\*|\*\*([^*_]+)\*\*|\*([^*_]+)\*|___([^*_]+)___|__([^*_]+)__|_([^*_]+)_",
        r"\1\2\3\4\5\6",
    )
    t = Q.sub(Q.sub(t, r"(?m)^>\s*", ""), r"(?m)^#{1,6}\s+", "")
    t = Q.sub(Q.sub(t, r"(?m)^\s*[-*+]\s+", ""), r"(?m)^\s*\d+\.\s+", "")
    t = Q.sub(t, r"(?m)^[-*_]{3,}\s*$", "")
    return strip(Q.sub(Q.sub(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


_MD = {
    "v_md0": r"""SELECT doc_id, regexp_replace(text, '\n', chr(10) || chr(10) || '* item' || chr(10) || '1. step ', 'g') AS b
                 FROM documents""",
    "v_md": f"""
        SELECT doc_id, 'note ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'Plain *note* ' || b ELSE
            '# Book ' || doc_id || {lit(chr(10) * 2 + 'Intro **bold** and _soft_ [link](http://x.y/z) ![pic](a.png)' + chr(10) * 2 + '## Part one' + chr(10))}
            || b || {lit(chr(10) * 2 + '```py' + chr(10) + 'code here' + chr(10) + '```' + chr(10) + '> quoted `inline`' + chr(10) * 2 + '---' + chr(10) + '### Deep' + chr(10) + 'end <b>tag</b>')}
            END AS x FROM v_md0""",
    "v_md_parts": r"""
        SELECT doc_id, title, x, string_split(regexp_replace(x, '(?m)^(#{1,2}\s+)', chr(1) || '\1', 'g'), chr(1)) AS ss
        FROM v_md""",
    "v_md_sec": rf"""
        SELECT doc_id, i, trim(regexp_extract({strip('s')}, '(?m)^#{{1,2}}\s+(.+)$', 1)) AS title, {_plain_md(strip('s'))} AS text
        FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM v_md_parts WHERE len(ss) > 1)
        WHERE {strip('s')} <> ''""",
    "v_md_single": f"SELECT doc_id, title, {_plain_md('x')} AS t FROM v_md_parts WHERE len(ss) = 1",
}

_SUBS = {
    "v_cues": """
        SELECT conv_id, string_agg(role || chr(1) || text, chr(2) ORDER BY turn) AS c, list(role || ' ' ||
               array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)),
                 lambda l: l <> '' AND NOT regexp_matches(l, '^(?:WEBVTT|NOTE|STYLE)|^\\d+$|-->')), ' ') ORDER BY turn) AS cues0
        FROM conversations GROUP BY conv_id""",
    "v_cues1": "SELECT conv_id, list_transform(cues0, lambda c: regexp_replace(c, '<[^>]*>', '', 'g')) AS cues FROM v_cues",
    "v_cues2": r"""
        SELECT conv_id, list_reduce(list_transform(cues, lambda c: {'o': []::VARCHAR[], 'b': c}),
            lambda a, x: CASE WHEN length(a.b) > 350 OR regexp_matches(a.b, '[.!?]$')
                              THEN {'o': list_append(a.o, a.b), 'b': x.b}
                              ELSE {'o': a.o, 'b': a.b || ' ' || x.b} END) AS r FROM v_cues1""",
    "v_subs": """
        SELECT conv_id, 'talk' AS title, array_to_string(list_append(r.o, r.b), chr(10) || chr(10)) AS t FROM v_cues2""",
}

_TALK = {
    "v_talk": """
        SELECT conv_id, 'talk' AS title, CASE WHEN conv_id % 7 = 0 THEN '{broken ' || array_to_string(list_transform(turns, lambda x: x.text), chr(10))
            WHEN conv_id % 5 = 0 THEN """
    + strip("array_to_string(list_transform(turns, lambda x: x.text), chr(10))")
    + """ ELSE array_to_string(list_transform(turns, lambda x: x.text), chr(10) || chr(10)) END AS t FROM v_turns""",
}

_DELIM = {
    "v_delim": """
        SELECT doc_id, 'table' AS title, 'id: ' || doc_id || ' · Col 2: ' ||
               trim(regexp_replace(text, '[\\n,"'']', ' ', 'g')) || ' · lang: ' || lang || chr(10) || chr(10) ||
               'id:  · Col 2: x · lang: y · Col 4: ' || doc_id AS t FROM documents""",
}


def _visible(t: str) -> str:
    t = Q.sub(t, r"<[^>]*>", "")
    # the references that the pages hold
    for name, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = f"replace({t}, {lit(name)}, {lit(char)})"
    return strip(t)


def _no_containers(t: str) -> str:
    t = Q.sub(t, r"(?s)<!--.*?(?:-->|\z)", "")
    for tag in P.HTML_DROPPED:
        t = Q.sub(t, rf"(?is)<{tag}(?:\s[^>]*|/[^>]*)?>.*?(?:</{tag}\s*>|\z)", "")
    for tag in ("h1", "h2"):
        t = Q.sub(t, rf"(?is)<{tag}(?:\s[^>]*)?>\s*(?:<[^>]*>\s*)*?</{tag}\s*>", "")
    return t


_TAGS = "|".join(P.HTML_BLOCKS)
_HTML = {
    "v_html0": rf"""
        SELECT page_id, {_no_containers('html')} AS h,
               {_visible("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")} AS title FROM pages""",
    "v_html1": rf"""
        SELECT page_id, title, unnest(ss) AS s, generate_subscripts(ss, 1) AS i
        FROM (SELECT page_id, title, string_split(regexp_replace(h, '(?i)(<h[12][\s>/])', chr(1) || '\1', 'g'), chr(1)) AS ss
              FROM v_html0)""",
    "v_html2": rf"""
        SELECT page_id, title, i, regexp_matches(s, '(?i)^<h[12][\s>/]') AS head,
               list_filter(list_transform(regexp_split_to_array(s, '(?i)<(?:{_TAGS})(?:[\s/][^>]*)?>')[2:],
                 lambda p: {_visible(f"regexp_split_to_array(p, '(?i)</(?:{_TAGS})" + chr(92) + "s*>')[1]")}),
                 lambda b: b <> '') AS bs FROM v_html1""",
    "v_html3": """
        SELECT page_id, i AS sec, CASE WHEN head THEN bs[1] ELSE title END AS title,
               array_to_string(bs, chr(10) || chr(10)) AS t FROM v_html2 WHERE len(bs) > 0""",
    "v_html_long": "SELECT * FROM v_html3 WHERE length(t) > 3500",
}

_SCORE = f"""
    (1.5::DOUBLE * {cnt('w', chr(92) + 'p{L}')} + 0.4::DOUBLE * {cnt('w', chr(92) + 'p{Nd}')}
     + 0.8::DOUBLE * len(regexp_extract_all(w, '[ .,:;!?\\-_/()\\[\\]''"]'))
     - 2.0::DOUBLE * (length(w) - {cnt('w', chr(92) + 'p{L}')} - {cnt('w', chr(92) + 'p{Nd}')}
              - len(regexp_extract_all(w, '[ .,:;!?\\-_/()\\[\\]''"]')))
     - CASE WHEN run3 THEN 4.0 ELSE 0 END
     - CASE WHEN regexp_matches(w, '[0-9][A-Za-z]|[A-Za-z][0-9]') THEN 2.0 ELSE 0 END
     - CASE WHEN regexp_matches(w, '[§©®™_~|=]') THEN 6.0 ELSE 0 END
     - CASE WHEN {cnt('w', chr(92) + 'p{L}')}::DOUBLE / length(w) < 0.4 THEN 3.0 ELSE 0 END)"""

_RUN3 = """len(list_filter(generate_series(1, length(w) - 2), lambda j: w[j] = w[j + 1] AND w[j] = w[j + 2])) > 0"""


def _quality(lines: str, prefix: str) -> dict[str, str]:
    """Word scores and junk flags of the lines of a view: ``<prefix>_words`` and ``<prefix>_lines``."""
    return {
        f"{prefix}_w0": rf"""
            SELECT {PAGE}, line_no, w, i, {_RUN3} AS run3
            FROM (SELECT {PAGE}, line_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
                  FROM (SELECT {PAGE}, line_no, regexp_split_to_array({strip('text')}, '\s+') AS ws FROM {lines}))""",
        f"{prefix}_words": f"SELECT {PAGE}, line_no, w, i, {_SCORE} AS score FROM {prefix}_w0",
        f"{prefix}_lines": f"""
            SELECT {PAGE}, line_no, any_value(text) AS text, sum(score) AS score,
                   {cnt('any_value(text)', chr(92) + 'p{L}')} = 0
                   OR {cnt('any_value(text)', chr(92) + 'p{L}')}::DOUBLE / {cnt('any_value(text)', chr(92) + 'S')} < 0.35
                   OR count(*) FILTER (WHERE score < 0)::DOUBLE / count(*) > 0.65
                   OR regexp_matches(any_value(text), '[§©®™_=|~\\[\\]{{}}]') AS junk
            FROM {prefix}_words JOIN {lines} USING ({PAGE}, line_no) GROUP BY {PAGE}, line_no""",
    }


def _page_words(lines: str) -> str:
    """SQL list of the repaired words of each page of a view."""
    joined = f"replace({strip('string_agg(text, chr(10) ORDER BY line_no)')}, chr(173), '-')"
    return f"SELECT {PAGE}, {Q.sub(joined, chr(92) + 's*[-–—]' + chr(92) + 's*', '-')} AS t FROM {lines} GROUP BY {PAGE}"


_AUDIT = {
    "v_ma_a0": _page_words("v_lines"),
    "v_ma_b0": _page_words("v_ocr_lines"),
    "v_ma_a1": f"SELECT {PAGE}, {Q.dehyphenate('t')} AS t FROM v_ma_a0",
    "v_ma_b1": f"SELECT {PAGE}, {Q.dehyphenate('t')} AS t FROM v_ma_b0",
    "v_ma_a": f"SELECT {PAGE}, list_filter(regexp_split_to_array({strip(Q.repair_core('t'))}, '\\s+'), lambda w: w <> '') AS a FROM v_ma_a1",
    "v_ma_b": f"SELECT {PAGE}, list_filter(regexp_split_to_array({strip(Q.repair_core('t'))}, '\\s+'), lambda w: w <> '') AS b FROM v_ma_b1",
    "v_ma_both": f"SELECT {PAGE}, coalesce(a, []) AS a, coalesce(b, []) AS b FROM v_ma_a FULL JOIN v_ma_b USING ({PAGE})",
    "v_ma_words": f"""
        SELECT {PAGE}, i, side, w, {_RUN3} AS run3 FROM (
          SELECT {PAGE}, 'a' AS side, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM v_ma_both
          UNION ALL SELECT {PAGE}, 'b', unnest(b), generate_subscripts(b, 1) FROM v_ma_both)""",
    "v_ma_scored": f"SELECT *, {_SCORE} AS score FROM v_ma_words",
    "v_ma_pairs": f"""
        SELECT {PAGE}, i, coalesce(max(w) FILTER (side = 'a'), '') AS a, coalesce(max(w) FILTER (side = 'b'), '') AS b,
               max(score) FILTER (side = 'a') AS sa, max(score) FILTER (side = 'b') AS sb FROM v_ma_scored GROUP BY {PAGE}, i""",
    "v_ma_tags": f"""
        SELECT {PAGE}, i, a, b, CASE WHEN a = '' THEN 'OCR' WHEN b = '' THEN 'PDF' WHEN a = b THEN 'same'
               WHEN abs(sa - sb) < 1 THEN CASE WHEN length(a) >= length(b) THEN 'PDF' ELSE 'OCR' END
               WHEN sa >= sb THEN 'PDF' ELSE 'OCR' END AS tag FROM v_ma_pairs""",
    "v_ma_sums": f"""
        SELECT {PAGE}, string_agg(CASE tag WHEN 'same' THEN a WHEN 'PDF' THEN 'PDF:' || a ELSE 'OCR:' || b END, ' ' ORDER BY i) AS tokens,
               count(*) FILTER (tag = 'PDF') AS from_pdf, count(*) FILTER (tag = 'OCR') AS from_ocr, count(*) FILTER (tag = 'same') AS same
        FROM v_ma_tags GROUP BY {PAGE}""",
}

_PARTS = {
    "v_sections": f"""
        SELECT *, '=== ' || label || ' ===' || chr(10) || CASE WHEN {strip('raw_text')} = '' THEN '' ELSE {strip('raw_text')} || chr(10) END AS section
        FROM v_issue_pages""",
    "v_parts": """
        SELECT *, ((sum(octet_length(encode(section)) + 1) OVER (PARTITION BY issue_id ORDER BY page_no)
                    - octet_length(encode(section)) - 1) // 30000)::INT AS file_no FROM v_sections""",
}

_SIDES = {
    **_quality("v_lines", "v_qa"),
    **_quality("v_ocr_lines", "v_qb"),
    **{
        f"v_side_{s}": f"""
            SELECT l.issue_id, l.page_no, l.text, l."left", l.top, l.width, l.height, q.score, q.line_no AS orig,
                   row_number() OVER (PARTITION BY l.issue_id, l.page_no ORDER BY l.line_no) AS line_no
            FROM {lines} l JOIN v_q{s}_lines q USING ({PAGE}, line_no) WHERE NOT q.junk"""
        for s, lines in (("a", "v_lines"), ("b", "v_ocr_lines"))
    },
    "v_pair": f"""
        SELECT coalesce(a.issue_id, b.issue_id) AS issue_id, coalesce(a.page_no, b.page_no) AS page_no,
               coalesce(a.line_no, b.line_no) AS line_no, a.text AS ta, b.text AS tb, a.orig AS ao, b.orig AS bo,
               a."left" AS al, a.top AS a_top, a.width AS aw, a.height AS ah,
               b."left" AS bl, b.top AS b_top, b.width AS bw, b.height AS bh, a.score AS asc0, b.score AS bsc0
        FROM v_side_a a FULL JOIN v_side_b b USING (issue_id, page_no, line_no)""",
    "v_pair_kind": """
        SELECT *, CASE WHEN tb IS NULL THEN 'a' WHEN ta IS NULL THEN 'b'
            WHEN abs(a_top - b_top) <= 2.0 * greatest(ah, bh) THEN 'm' WHEN asc0 >= bsc0 THEN 'a' ELSE 'b' END AS how
        FROM v_pair""",
    "v_pair_words": f"""
        SELECT p.issue_id, p.page_no, p.line_no, p.i, x.w AS aw0, y.w AS bw0,
               CASE WHEN x.w IS NULL THEN y.w WHEN y.w IS NULL OR x.w = y.w THEN x.w
                    WHEN abs(x.score - y.score) < 1.0 THEN CASE WHEN length(x.w) >= length(y.w) THEN x.w ELSE y.w END
                    WHEN x.score >= y.score THEN x.w ELSE y.w END AS w
        FROM (SELECT *, unnest(generate_series(1, greatest(
                 len(regexp_split_to_array({strip('ta')}, '\\s+')), len(regexp_split_to_array({strip('tb')}, '\\s+'))))) AS i
              FROM v_pair_kind WHERE how = 'm') p
        LEFT JOIN v_qa_words x ON x.issue_id = p.issue_id AND x.page_no = p.page_no AND x.line_no = p.ao AND x.i = p.i
        LEFT JOIN v_qb_words y ON y.issue_id = p.issue_id AND y.page_no = p.page_no AND y.line_no = p.bo AND y.i = p.i""",
    "v_pair_text": f"""
        SELECT {PAGE}, line_no, string_agg(w, ' ' ORDER BY i) AS mt FROM v_pair_words GROUP BY {PAGE}, line_no""",
    "v_merged_lines": f"""
        SELECT {PAGE}, line_no, CASE how WHEN 'a' THEN ta WHEN 'b' THEN tb ELSE mt END AS text,
               CASE how WHEN 'a' THEN al WHEN 'b' THEN bl ELSE least(al, bl) END AS "left",
               CASE how WHEN 'a' THEN a_top WHEN 'b' THEN b_top ELSE least(a_top, b_top) END AS top,
               CASE how WHEN 'a' THEN aw WHEN 'b' THEN bw ELSE greatest(al + aw, bl + bw) - least(al, bl) END AS width,
               CASE how WHEN 'a' THEN ah WHEN 'b' THEN bh ELSE greatest(a_top + ah, b_top + bh) - least(a_top, b_top) END
                 AS height,
               CASE WHEN tb IS NULL THEN 'PDF' WHEN ta IS NULL THEN 'OCR' ELSE 'PDF+OCR' END AS source_kind
        FROM v_pair_kind LEFT JOIN v_pair_text USING ({PAGE}, line_no)""",
    **_quality("v_merged_lines", "v_qm"),
}

SQL = {
    "paginate_words": _paged_sql(_DOCS, "v_docs", "doc_id"),
    "paragraph_boxes": compose(f"""
        SELECT doc_id, i AS line_no, p AS text, 50 AS "left", CAST(floor(145 + (i - 1) * (h + 12) + 0.5) AS INT) AS top,
               700 AS width, CASE WHEN i = 1 AND length(p) < 50 AND NOT contains(p, '.') THEN 36
                                  ELSE CAST(floor(h + 0.5) AS INT) END AS height
        FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i,
                     least(180::DOUBLE, greatest(40::DOUBLE, (890 - greatest(1, len(ps)) * 12)::DOUBLE / greatest(1, len(ps)))) AS h
              FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'),
                             lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM v_docs))""", _DOCS),
    "markdown_sections": compose(
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page_no, title, text FROM v_md_sec
           UNION ALL SELECT doc_id, page_no, title, text FROM v_paged""",
        {**_MD, **paged("v_md_single", "doc_id")}),
    "entity_text": "SELECT doc_id, '&lt; ' || text AS text FROM documents",
    "html_sections": compose(
        """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY sec, page_no) AS page_no, title, text FROM (
             SELECT page_id, sec, 1 AS page_no, title, t AS text FROM v_html3 WHERE length(t) <= 3500
             UNION ALL SELECT page_id, sec, page_no, title, text FROM v_paged)""",
        {**_HTML, **paged("v_html_long", "page_id, sec")}),
    "subtitle_pages": _paged_sql(_SUBS, "v_subs", "conv_id"),
    "transcript_pages": _paged_sql(_TALK, "v_talk", "conv_id"),
    "delimited_rows": _paged_sql(_DELIM, "v_delim", "doc_id"),
    "merge_audit": compose(f"""
        SELECT {PAGE}, coalesce(tokens, '') AS tokens, coalesce(from_pdf, 0)::INT AS from_pdf, coalesce(from_ocr, 0)::INT AS from_ocr,
               coalesce(same, 0)::INT AS same FROM v_ma_both LEFT JOIN v_ma_sums USING ({PAGE})""", _AUDIT),
    "page_dump": compose(f"SELECT issue_id, file_no, label, {strip('raw_text')} AS body FROM v_parts", _PARTS),
    "page_dump_text": compose(f"""
        SELECT issue_id, file_no, {strip("string_agg(section, chr(10) ORDER BY page_no)")} || chr(10) AS text
        FROM v_parts GROUP BY issue_id, file_no""", _PARTS),
    "word_lines": compose(f"""
        SELECT {PAGE}, row_number() OVER (PARTITION BY {PAGE} ORDER BY block_num, par_num, line_num) AS line_no,
               text, "left", top, width, height
        FROM (SELECT {PAGE}, block_num, par_num, line_num, level, string_agg({strip('text')}, ' ' ORDER BY word_no) AS text,
                     min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width,
                     max(top + height) - min(top) AS height
              FROM (SELECT *, max((level = 4)::INT) OVER (PARTITION BY {PAGE}) AS has4 FROM v_words)
              WHERE level = CASE WHEN has4 = 1 THEN 4 ELSE 5 END AND {strip('text')} <> ''
              GROUP BY {PAGE}, block_num, par_num, line_num, level)"""),
    "span_lines": layout_q(f"""
        SELECT {PAGE}, row_number() OVER (PARTITION BY {PAGE} ORDER BY band, island) AS line_no,
               {strip('''string_agg(text, ' ' ORDER BY x0, span_no)''')} AS text, greatest(0, min(x0)) AS "left",
               greatest(0, min(y0)) AS top, greatest(16, max(x1) - min(x0)) AS width, greatest(14, max(y1) - min(y0)) AS height
        FROM v_islands GROUP BY {PAGE}, band, island""",
        {
            "v_spans": f"""
                SELECT {PAGE}, block_num * 100000 + line_num * 1000 + word_no AS span_no, text, "left" AS x0,
                       "left" + width AS x1, top AS y0, top + height AS y1, height AS font
                FROM v_words WHERE level = 5 AND {strip('text')} <> ''""",
            "v_bands": f"""
                SELECT *, sum(j) OVER (PARTITION BY {PAGE} ORDER BY y0, x0, span_no ROWS UNBOUNDED PRECEDING) AS band
                FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER w > 0.6 * least(font, lag(font) OVER w) THEN 1 ELSE 0 END AS j
                      FROM v_spans WINDOW w AS (PARTITION BY {PAGE} ORDER BY y0, x0, span_no))""",
            "v_islands": f"""
                SELECT *, sum(c) OVER (PARTITION BY {PAGE}, band ORDER BY x0, span_no ROWS UNBOUNDED PRECEDING) AS island
                FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER w BETWEEN -4 AND greatest(28, 2.2 * greatest(font, lag(font) OVER w))
                                     THEN 0 ELSE 1 END AS c
                      FROM v_bands WINDOW w AS (PARTITION BY {PAGE}, band ORDER BY x0, span_no))""",
        }),
    "image_catalog": """
        SELECT folder, name, seq, n_seq, 'Image ' || seq || '/' || n_seq || ': ' || name AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY lower(name), name) AS seq,
                     count(*) OVER (PARTITION BY folder) AS n_seq
              FROM (SELECT '/scan/' || source AS folder, CASE WHEN doc_id % 2 = 0 THEN 'Page_' ELSE 'page_' END
                           || md5(CAST(doc_id AS VARCHAR)) || ['.PNG', '.jpg', '.txt', '.Tiff'][doc_id % 4 + 1] AS name
                    FROM documents WHERE doc_id % 4 <> 2))""",
    "page_range": compose("SELECT issue_id, page_no, label FROM v_issue_pages WHERE page_no BETWEEN 13 AND 22"),
    "source_prefer": compose(f"""
        SELECT {PAGE}, line_no, text, 'PDF' AS source_kind FROM v_lines WHERE page_no % 3 <> 0
        UNION ALL SELECT {PAGE}, line_no, text, 'OCR' FROM v_ocr_lines WHERE page_no % 3 = 0"""),
    "word_quality": compose(f"SELECT {PAGE}, line_no, round(score, 6) AS score, junk AS is_junk FROM v_qb_lines", _SIDES),
    "source_merge": compose(f"""
        SELECT m.issue_id, m.page_no, m.line_no, m.text, m."left", m.top, m.width, m.height, m.source_kind
        FROM v_merged_lines m JOIN v_qm_lines q USING ({PAGE}, line_no) WHERE NOT q.junk""", _SIDES),
}

SQL["span_blocks"] = layout_q(
    f"""SELECT {PAGE}, block_num AS line_no, text, x0 * 2 AS "left", y0 * 2 AS top, (x1 - x0) * 2 AS width,
               (y1 - y0) * 2 AS height FROM v_blk""",
    {
        "v_blk_lines": f"""
            SELECT {PAGE}, block_num, line_num, string_agg(text, chr(1) ORDER BY word_no) AS raw,
                   min("left") AS x0, min(top) AS y0, max("left" + width) AS x1, max(top + height) AS y1
            FROM v_words WHERE level = 5 GROUP BY {PAGE}, block_num, line_num""",
        "v_blk_fix": f"""
            SELECT *, {strip("replace(list_reduce(string_split(raw, chr(1)), lambda a, x: CASE WHEN regexp_matches(a, '[" + chr(92) + "p{L}" + chr(92) + "p{N}]$') AND regexp_matches(x, '^[" + chr(92) + "p{L}" + chr(92) + "p{N}]') THEN a || ' ' || x ELSE a || x END), chr(1), '')")} AS text
            FROM v_blk_lines""",
        "v_blk": f"""
            SELECT {PAGE}, block_num, {join_fold("list(text ORDER BY line_num)")} AS text,
                   min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
            FROM v_blk_fix WHERE text <> '' GROUP BY {PAGE}, block_num""",
    },
)


def _as_files(name: str, key: str, ext: str, title: str | None) -> str:
    """A format's twin as pages of files; files are titled by their name instead of ``title``."""
    body = SQL[name]
    if title is not None:
        assert title in body, (name, title)
        body = body.replace(title, f"'file ' || {key} AS title")
    return f"SELECT '/in/{ext}/file_' || {key} || '.{ext}' AS path, page_no, title, text FROM ({body})"


SQL["ingest_all"] = " UNION ALL ".join(
    [
        _as_files("markdown_sections", "doc_id", "md", "'note ' || doc_id AS title"),
        _as_files("delimited_rows", "doc_id", "csv", "'table' AS title"),
        _as_files("paginate_words", "doc_id", "txt", "'Doc ' || doc_id AS title"),
        _as_files("subtitle_pages", "conv_id", "srt", "'talk' AS title"),
        _as_files("transcript_pages", "conv_id", "json", "'talk' AS title"),
        _as_files("html_sections", "page_id", "html", None),
    ]
)

SQL["rtf_text"] = f"""
    WITH cut AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND contains(text, chr(10)) THEN
           [text[1:instr(text, chr(10)) - 1], text[instr(text, chr(10)) + 1:]] ELSE [text] END AS ps FROM documents),
    kept AS (SELECT doc_id, list_filter(list_transform(ps, lambda p: {strip('replace(p, chr(10), chr(10) || chr(32))')}), lambda p: p <> '') AS ps FROM cut)
    SELECT doc_id, unnest(CASE WHEN len(ps) = 0 THEN [''] ELSE ps END) AS text,
           generate_subscripts(CASE WHEN len(ps) = 0 THEN [''] ELSE ps END, 1)::INT AS page_no FROM kept"""
