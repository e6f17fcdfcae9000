"""Registered queries over layout (A11, A12, B01-B12) and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.checks.sql_layout import LAYOUT_VIEWS, PAGE, q, rule_sql
from quire.operators import layout as B
from quire.plans import views as V

KEY = ("issue_id", "page_no")
BOX = ("left", "top", "width", "height")


def page_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return B.page_metrics(V.layout_lines(spark, sf)).select(
        *KEY, "n", "med_h", "min_left", "max_right", "text_width", "page_top", "band"
    )


def rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    return B.flag_rules(V.layout_lines(spark, sf)).select(*KEY, "line_no", "is_page_rule", "is_box_rule")


def page_split(spark: SparkSession, sf: str) -> DataFrame:
    return B.page_split(V.layout_lines(spark, sf))


def column_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return B.cluster_columns(V.layout_lines(spark, sf)).select(*KEY, "half", "col_no", "lo", "hi", "n_lines")


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return B.reading_order(V.layout_lines(spark, sf)).select(*KEY, "line_no", "read_no", "half", "is_title", "block")


def reading_order_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Columns measured by their outer edges; box rules split the columns of some pages."""
    return B.reading_order(V.layout_lines(spark, sf), narrow="extent").select(
        *KEY, "line_no", "read_no", "half", "is_title", "block", F.col("col_x").isNotNull().alias("in_column")
    )


def _web_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The layout lines with further gaps, a banner above and one below the columns of some pages."""
    lines = V.layout_lines(spark, sf)
    n, p = F.col("line_no"), F.col("page_no")
    wide = F.col("n_lines") >= 6
    lower = F.when(wide & (n > 16), 160).otherwise(0) + F.when(wide & (n > 40), 180).otherwise(0)
    banner = wide & (((n == 1) & (p % 3 == 0)) | ((n == F.col("n_lines")) & (p % 5 == 0)))
    return lines.withColumn("top", (F.col("top") + lower).cast("int")).withColumn(
        "left", F.when(banner, 40).otherwise(F.col("left")).cast("int")
    ).withColumn("width", F.when(banner, 560).otherwise(F.col("width")).cast("int"))


def reading_order_web(spark: SparkSession, sf: str) -> DataFrame:
    return B.reading_order_web(_web_lines(spark, sf)).select(*KEY, "line_no", "read_no", "region", "part", "col_no")


def chunks_web(spark: SparkSession, sf: str) -> DataFrame:
    ordered = B.reading_order(V.layout_lines(spark, sf), narrow="extent")
    return B.chunk_breaks(ordered, max_chars=450, profile="web").select(*KEY, "line_no", "read_no", "chunk_no")


def chunk_breaks(spark: SparkSession, sf: str) -> DataFrame:
    ordered = B.reading_order(V.layout_lines(spark, sf))
    return B.chunk_breaks(ordered).select(*KEY, "line_no", "read_no", "chunk_no")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    ordered = B.reading_order(V.layout_lines(spark, sf))
    return B.merge_chunks(ordered).select(*KEY, "chunk_no", "text", *BOX, "n_lines")


def caps_runs(spark: SparkSession, sf: str) -> DataFrame:
    return B.join_caps_runs(V.layout_lines(spark, sf)).select(*KEY, "line_no", "text", "n_joined")


def noise_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth page is made unreadable; its source carries an issue date in two of three cases."""
    lines = V.layout_lines(spark, sf)
    text = F.when(F.col("page_no") % 5 == 0, F.lit("= = =")).otherwise(F.col("text"))
    units = lines.select(
        *KEY, (F.col("line_no") - 1).alias("chunk_no"), text.alias("text"), *BOX, F.lit(1).cast("long").alias("n_lines")
    )
    source = F.concat(
        F.lit("/scans/"),
        F.when(F.col("page_no") % 3 == 0, "").otherwise("1976_"),
        F.lpad((F.col("page_no") % 14).cast("string"), 2, "0"),
        F.lit("_mag.pdf"),
    )
    sources = lines.select(*KEY).distinct().withColumn("source", source)
    return B.suppress_noise_pages(units, sources).select(*KEY, "chunk_no", "text", *BOX)


QUERIES = {
    "page_metrics": page_metrics,
    "rule_lines": rule_lines,
    "page_split": page_split,
    "column_clusters": column_clusters,
    "reading_order": reading_order,
    "reading_order_extent": reading_order_extent,
    "reading_order_web": reading_order_web,
    "chunks_web": chunks_web,
    "chunk_breaks": chunk_breaks,
    "chunks": chunks,
    "caps_runs": caps_runs,
    "noise_pages": noise_pages,
}

_BOX = '"left", top, width, height'
_MONTH_NAME = "monthname(make_date(2000, CAST(page_no % 14 AS INT), 1))"

_EXTENT = {"v_opens": LAYOUT_VIEWS["v_opens"].replace("c.hi - c.lo <", "any_value(c.ext) <")}
_HEAD = r"^(?i)(\d+[.)]|[•\-*]|MODEL|KIT|SPECIAL|TABLE|FIGURE|PAGE|SECTION|THE MOST|COMPLETE|NEW|JUMBO)"
_WEB = {
    **_EXTENT,
    "v_chunk_flags": f"""
        SELECT *, p_left IS NULL OR ov < 0.2 * greatest(1, least(width, p_width)) OR gap > avg_h * 1.4
               OR (p_left = "left" AND p_top = top AND p_width = width AND p_height = height)
               OR (((length(text) < 55 AND text = upper(text) AND regexp_matches(text, '[A-Z]'))
                    OR regexp_matches(trim(text), '{_HEAD}'))
                   AND (regexp_matches(trim(p_text), '(?i)(\\$\\d+(\\.\\d{{2}})?|\\b(ea|each|kit|only|total)\\b|[.!?…:])$')
                        OR gap > avg_h * 0.4)) AS hard
        FROM (SELECT *, least(p_left + p_width, "left" + width) - greatest(p_left, "left") AS ov,
                     top - (p_top + p_height) AS gap, greatest(1.0, (p_height + height) / 2.0) AS avg_h
              FROM (SELECT *, lag("left") OVER w AS p_left, lag(top) OVER w AS p_top, lag(width) OVER w AS p_width,
                           lag(height) OVER w AS p_height, lag(text) OVER w AS p_text
                    FROM v_order WINDOW w AS (PARTITION BY {PAGE} ORDER BY read_no)))""",
    "v_rec_chunks": LAYOUT_VIEWS["v_rec_chunks"].replace("> 400", "> 450"),
}

_CUT = "PARTITION BY issue_id, page_no, region"
_REGION = {
    "v_web": f"""
        SELECT {PAGE}, line_no, height, CASE WHEN banner THEN 40 ELSE "left" END AS "left", CASE WHEN banner THEN 560 ELSE width END AS width,
               top + CASE WHEN n_lines >= 6 AND line_no > 16 THEN 160 ELSE 0 END + CASE WHEN n_lines >= 6 AND line_no > 40 THEN 180 ELSE 0 END AS top
        FROM (SELECT *, n_lines >= 6 AND ((line_no = 1 AND page_no % 3 = 0) OR (line_no = n_lines AND page_no % 5 = 0)) AS banner FROM v_lines)""",
    "v_rec_region": f"""
        SELECT {PAGE}, line_no, "left", top, width, height, '' AS region, false AS whole FROM v_web
        UNION ALL
        SELECT {PAGE}, line_no, "left", top, width, height,
               CASE WHEN cut AND above THEN region || '0' WHEN cut THEN region || '1' ELSE region END, NOT cut
        FROM (SELECT *, coalesce(sum(above::INT) OVER ({_CUT}) >= 2 AND sum(below::INT) OVER ({_CUT}) >= 2, false) AS cut
              FROM (SELECT *, top + height <= y AS above, top >= y AS below
                    FROM (SELECT *, (max(CASE WHEN gap > greatest(70, tall) THEN [gap, -rn, top + height + gap / 2.0::DOUBLE] END) OVER ({_CUT}))[3] AS y
                          FROM (SELECT *, row_number() OVER w AS rn, lead(top) OVER w - top - height AS gap,
                                       (height + lead(height) OVER w) / 2.0::DOUBLE * 2.8::DOUBLE AS tall
                                FROM v_rec_region WHERE NOT whole WINDOW w AS ({_CUT} ORDER BY top, line_no)))))
        WHERE NOT cut OR above OR below""",
    "v_web0": f"""
        SELECT *, "left" + width / 2.0::DOUBLE AS mid, count(*) OVER r AS n, max("left" + width) OVER r - min("left") OVER r AS pw,
               max("left" + width / 2.0::DOUBLE) OVER r - min("left" + width / 2.0::DOUBLE) OVER r AS span
        FROM v_rec_region WHERE whole WINDOW r AS ({_CUT})""",
    "v_web1": f"""
        SELECT *, sum(opens) OVER ({_CUT} ORDER BY mid, line_no ROWS UNBOUNDED PRECEDING) AS cid
        FROM (SELECT *, coalesce(mid - lag(mid) OVER ({_CUT} ORDER BY mid, line_no) >= greatest(45.0::DOUBLE, 0.07::DOUBLE * pw), false)::INT AS opens
              FROM v_web0)""",
    "v_web2": f"""
        SELECT *, row_number() OVER ({_CUT} ORDER BY lo) - 1 AS col, count(*) OVER ({_CUT}) AS cols
        FROM (SELECT {PAGE}, region, cid, min(mid) - 1 AS lo, max(mid) + 1 AS hi FROM v_web1
              GROUP BY {PAGE}, region, cid, n, span
              HAVING count(*) >= CASE WHEN n < 8 THEN 2 ELSE 3 END AND n >= CASE WHEN n < 8 THEN 4 ELSE 6 END AND span >= 120)""",
    "v_web3": f"""
        SELECT l.issue_id, l.page_no, l.region, l.line_no, min([CASE WHEN mid BETWEEN lo AND hi THEN -1
               ELSE least(abs(mid - lo), abs(mid - hi)) END, col])[2] AS col
        FROM v_web1 l JOIN v_web2 c USING (issue_id, page_no, region) WHERE cols >= 2 GROUP BY ALL""",
    "v_web4": f"""
        SELECT *, CASE WHEN col IS NULL THEN NULL WHEN NOT wide THEN 1 WHEN coalesce(start, 0) = 0 OR top < start THEN 0 ELSE 2 END AS part,
               CASE WHEN NOT wide THEN col::INT END AS col_no
        FROM (SELECT *, min(top) FILTER (col = 0 AND NOT wide) OVER ({_CUT}) AS start
              FROM (SELECT l.*, c.col, width > 0.65::DOUBLE * pw AS wide FROM v_web1 l LEFT JOIN v_web3 c USING (issue_id, page_no, region, line_no)))""",
    "v_rec_rows": f"""
        SELECT {PAGE}, region, min(top) AS begins FROM v_web4 WHERE part IS NULL GROUP BY ALL
        UNION ALL
        SELECT {PAGE}, region, (SELECT min(top) FROM v_web4 w WHERE (w.issue_id, w.page_no, w.region) = (r.issue_id, r.page_no, r.region)
               AND w.top >= r.begins + 12) FROM v_rec_rows r WHERE begins IS NOT NULL""",
    "v_web_order": f"""
        SELECT *, row_number() OVER (PARTITION BY {PAGE} ORDER BY region, part NULLS FIRST, col_no NULLS FIRST,
               CASE WHEN part IS NULL THEN (SELECT max(begins) FROM v_rec_rows r WHERE (r.issue_id, r.page_no, r.region)
                 = (w.issue_id, w.page_no, w.region) AND r.begins <= w.top) ELSE top END,
               CASE WHEN part IS NULL THEN "left" END NULLS FIRST, line_no) AS read_no FROM v_web4 w""",
}

SQL = {
    "reading_order_web": q(f"SELECT {PAGE}, line_no, read_no, region, part, col_no FROM v_web_order", _REGION),
    "reading_order_extent": q(
        f"SELECT {PAGE}, line_no, read_no, half, is_title, block, col_x IS NOT NULL AS in_column FROM v_order", _EXTENT
    ),
    "chunks_web": q(f"SELECT {PAGE}, line_no, read_no, chunk_no FROM v_chunk_lines", _WEB),
    "page_metrics": q(f"""
        SELECT {PAGE}, n, med_h, min_left, max_right, max_right - min_left AS text_width, page_top,
               greatest(4, CAST(floor(med_h * 0.6) AS INT)) AS band FROM v_metrics"""),
    "rule_lines": q(f"""
        SELECT {PAGE}, line_no, {rule_sql('text')} AND width >= 0.55 * greatest(1, max_right - min_left) AS is_page_rule,
               {rule_sql('text')} AND width >= 0.50 * greatest(1, max_right - min_left) AS is_box_rule
        FROM v_lines JOIN v_metrics USING ({PAGE})"""),
    "page_split": q(f"SELECT {PAGE}, split_y FROM v_split"),
    "column_clusters": q(f"SELECT {PAGE}, half, col_no, lo, hi, n_lines FROM v_clusters"),
    "reading_order": q(f"SELECT {PAGE}, line_no, read_no, half, is_title, block FROM v_order"),
    "chunk_breaks": q(f"SELECT {PAGE}, line_no, read_no, chunk_no FROM v_chunk_lines"),
    "chunks": q(f"SELECT {PAGE}, chunk_no, text, {_BOX}, n_lines FROM v_chunks"),
    "caps_runs": q(f"""
        SELECT {PAGE}, min(line_no) AS line_no,
               string_agg(CASE WHEN caps THEN trim(text) ELSE text END, ' ' ORDER BY line_no) AS text, count(*) AS n_joined
        FROM v_caps GROUP BY {PAGE}, run"""),
    "noise_pages": q(f"""
        SELECT {PAGE}, line_no - 1 AS chunk_no, text, {_BOX} FROM v_lines JOIN v_noise USING ({PAGE}) WHERE NOT noisy
        UNION ALL
        SELECT {PAGE}, 0, {_MONTH_NAME} || ' 1976 cover.', 0, 0, 100, 40 FROM v_noise
        WHERE noisy AND page_no % 3 <> 0 AND page_no % 14 BETWEEN 1 AND 12""",
        {"v_noise": f"""
            SELECT {PAGE}, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]')) < 20
                   OR len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]'))::DOUBLE / length(t) < 0.5 AS noisy
            FROM (SELECT {PAGE}, string_agg(CASE WHEN page_no % 5 = 0 THEN '= = =' ELSE text END, ' '
                                            ORDER BY line_no) AS t
                  FROM v_lines GROUP BY {PAGE})"""}),
}
