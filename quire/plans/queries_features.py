"""Registered queries over page features (D) and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.checks import sql_features as X
from quire.checks.sql_features import q
from quire.functions import patterns as P
from quire.functions import noise, scores
from quire.operators import features as D
from quire.plans import views as V

KEY = ("issue_id", "page_no")


def _joined(col: str) -> F.Column:  # type: ignore[name-defined]
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


def cues(spark: SparkSession, sf: str) -> DataFrame:
    out = D.cues(V.cue_pages(spark, sf))
    return out.select(*KEY, _joined("continued_on").alias("on_list"), _joined("continued_from").alias("from_list"))


def folios(spark: SparkSession, sf: str) -> DataFrame:
    out = D.folios(V.cue_pages(spark, sf)).withColumn("pdf_no", D.label_number(F.col("label")))
    return out.select(*KEY, "pdf_no", "folio", _joined(F.array_sort("edge_folios")).alias("edge_list"))


def prose(spark: SparkSession, sf: str) -> DataFrame:
    out = scores.with_text_features(V.cue_pages(spark, sf))
    return out.select(*KEY, "words", "chars", F.round("prose", 6).alias("prose"))


def ad_cues(spark: SparkSession, sf: str) -> DataFrame:
    out = scores.with_text_features(V.cue_pages(spark, sf))
    return out.select(*KEY, "cue_hits", F.round("density", 6).alias("density"))


def ads(spark: SparkSession, sf: str) -> DataFrame:
    out = D.page_features(V.cue_pages(spark, sf))
    return out.select(*KEY, "is_ad", "first_rule", "is_form", "is_body", "is_weak")


def ad_reasons(spark: SparkSession, sf: str) -> DataFrame:
    out = D.ads_with_reasons(V.cue_pages(spark, sf))
    return out.select(*KEY, "is_ad", F.array_join("ad_reasons", " | ").alias("reasons"))


def titles(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.cue_pages(spark, sf)
    out = D.titles(D.titles(pages), out="web_title", profile="web")
    return out.select(*KEY, "title", "web_title")


def issue_month(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.table(spark, sf, "documents").select("doc_id", "source")
    year, month = (F.col("doc_id") % 40 + 1960).cast("string"), (F.col("doc_id") % 14).cast("string")
    path = F.concat(
        F.lit("/scans/"), "source", F.when(F.col("doc_id") % 3 == 0, "/BYTE_").otherwise("/mag "),
        year, F.when(F.col("doc_id") % 2 == 0, "_").otherwise("-"), month,
        F.when(F.col("doc_id") % 5 == 0, "x.pdf").otherwise(" scan.pdf"),
    )
    return docs.select("doc_id", D.issue_month(path).alias("issue_month"))


def line_predicates(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.layout_lines(spark, sf)
    t = F.col("text")
    return lines.select(
        *KEY,
        "line_no",
        noise.url_or_artifact(t).alias("is_url"),
        noise.date_or_time(t).alias("is_date"),
        noise.page_number(t).alias("is_page_number"),
        noise.matches(t, P.PUBLISHER).alias("is_publisher"),
        noise.has_token(t, noise.name_tokens(F.concat("issue_id", F.lit("_the-de.PDF")))).alias("has_name_token"),
        noise.normal_header(t).alias("norm"),
    )


_DOC_PATH = """'/scans/' || source || CASE WHEN doc_id % 3 = 0 THEN '/BYTE_' ELSE '/mag ' END
    || (doc_id % 40 + 1960) || CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '-' END || (doc_id % 14)
    || CASE WHEN doc_id % 5 = 0 THEN 'x.pdf' ELSE ' scan.pdf' END"""
_DATE_RX = P.ISSUE_DATE

QUERIES = {
    "cues": cues,
    "folios": folios,
    "prose": prose,
    "ad_cues": ad_cues,
    "ads": ads,
    "ad_reasons": ad_reasons,
    "titles": titles,
    "issue_month": issue_month,
    "line_predicates": line_predicates,
}

_WEAK = """(first_rule IS NOT NULL OR (NOT is_body AND len(cfrom) = 0
    AND ((chars < 400 AND prose < 0.35) OR (chars < 600 AND prose < 0.28))))"""

SQL = {
    "cues": q("""SELECT issue_id, page_no, list_aggregate(con, 'string_agg', ',') AS on_list0,
                 coalesce(array_to_string(con, ','), '') AS on_list,
                 coalesce(array_to_string(cfrom, ','), '') AS from_list FROM v_feat0""").replace(
        "list_aggregate(con, 'string_agg', ',') AS on_list0,", ""
    ),
    "folios": q("""SELECT issue_id, page_no, pdf_no, folio,
                   coalesce(array_to_string(list_sort(edges), ','), '') AS edge_list FROM v_feat"""),
    "prose": q("SELECT issue_id, page_no, words, chars, round(prose, 6) AS prose FROM v_feat1"),
    "ad_cues": q("SELECT issue_id, page_no, hits AS cue_hits, round(density, 6) AS density FROM v_feat2"),
    "ads": q(f"""SELECT issue_id, page_no, is_ad, first_rule, is_form, is_body, {_WEAK} AS is_weak FROM v_feat"""),
    "ad_reasons": q("""
        SELECT issue_id, page_no, len(rs) > 0 AS is_ad, coalesce(array_to_string(rs, ' | '), '') AS reasons
        FROM (SELECT issue_id, page_no, CASE WHEN protected OR page_no = 1 THEN [] ELSE list_filter([
            CASE WHEN contains(raw_text, '!!!') OR bangs >= 4
                 THEN 'Multiple exclamation marks (shouty promotional style)' END,
            CASE WHEN shout_web THEN 'Promotional shout keywords (introducing, only $, etc.)' END,
            CASE WHEN words < 80 AND len(alpha) > 0 AND caps_ratio >= 0.25
                 THEN 'High proportion of all-caps advertising text' END,
            CASE WHEN hits_web >= 2 THEN 'Multiple commercial/ad cue keywords (' || hits_web || ' hits)' END,
            CASE WHEN hits_web >= 1 AND chars < 450 AND prose < 0.45
                 THEN 'Short text with ad cue and low prose score' END,
            CASE WHEN density_web >= 0.05 AND words >= 12 THEN 'High density of advertising words (>=5%)' END,
            CASE WHEN is_form THEN 'Order form or subscription fill-in coupon layout' END],
            lambda r: r IS NOT NULL) END AS rs FROM v_feat2)"""),
    "titles": q("""SELECT p.issue_id, p.page_no, title, web_title FROM v_cue_pages p
                   LEFT JOIN v_titles USING (issue_id, page_no)"""),
    "issue_month": f"""
        WITH b AS (SELECT doc_id, regexp_replace(string_split(p, '/')[-1], '\\.[^.]+$', '') || ' ' ||
                          array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '')[-4:], ' ') AS blob
                   FROM (SELECT doc_id, {_DOC_PATH} AS p FROM documents)),
             c AS (SELECT doc_id, CASE WHEN {X.rx("replace(blob, ' ', '_')", _DATE_RX)} THEN replace(blob, ' ', '_')
                                       WHEN {X.rx('blob', _DATE_RX)} THEN blob END AS hit FROM b)
        SELECT doc_id, regexp_extract(hit, {X.lit(_DATE_RX)}, 1) || '-'
                       || lpad(regexp_extract(hit, {X.lit(_DATE_RX)}, 2), 2, '0') AS issue_month FROM c""",
    "line_predicates": q(f"""
        SELECT issue_id, page_no, line_no, {X.url_sql('text')} AS is_url, {X.date_sql('text')} AS is_date,
               {X.rx('text', P.PAGE_NUMBER)} OR {X.rx('text', P.ROMAN_NUMBER)} OR {X.rx('text', P.BROWSER_ARTIFACT)}
                 OR {X.rx('text', P.PAGE_OF)} AS is_page_number,
               {X.rx('text', P.PUBLISHER)} AS is_publisher,
               contains(lower(text), issue_id) OR contains(lower(text), 'the') AS has_name_token,
               trim(regexp_replace(lower(text), {X.lit(P.HEADER_PUNCT)}, ' ', 'g')) AS norm
        FROM v_lines"""),
}
