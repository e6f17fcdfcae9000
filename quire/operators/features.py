"""Page features, predicates and classifiers (D01-D09, D12, D13, D16): one projection over pages, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import scores as S
from quire.functions.noise import date_or_time, url_or_artifact
from quire.functions.text import chars_of, let, matches, non_empty, strip, text_lines


def cues(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Page numbers named by "continued on" and "continued from" cues."""
    return pages.withColumn("continued_on", S.cue_numbers(text, P.CONTINUED_ON)).withColumn(
        "continued_from", S.cue_numbers(text, P.CONTINUED_FROM)
    )


def label_number(label: Column, profile: str = "page") -> Column:
    """Physical number of a ``Page N`` label; the web profile also accepts any digits."""
    number = F.regexp_extract(label, P.PAGE_LABEL, 1)
    if profile == "web":
        number = F.when(number == "", F.regexp_extract(label, r"(\d+)", 1)).otherwise(number)
    return number.try_cast("int")


def printed_numbers(lines: Column) -> Column:
    """Numbers of the lines that hold nothing but a decorated page number, in line order."""
    return F.transform(
        F.filter(lines, lambda s: matches(s, P.FOLIO_LINE)),
        lambda s: F.regexp_extract(s, P.FOLIO_LINE, 1).cast("int"),
    )


def folios(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """``folio`` (last candidate on the page) and ``edge_folios`` (in the first and last three lines)."""
    lines = non_empty(F.transform(text_lines(F.col(text)), strip))
    n = F.size("_ls")
    edge = F.when(n <= 6, F.col("_ls")).otherwise(
        F.concat(F.slice("_ls", F.lit(1), F.lit(3)), F.slice("_ls", n - 2, F.lit(3)))
    )
    return (
        pages.withColumn("_ls", lines)
        .withColumn("_all", printed_numbers(F.col("_ls")))
        .withColumn("edge_folios", F.array_distinct(printed_numbers(edge)))
        .withColumnRenamed("_all", "folio_list")
        .withColumn("folio", F.try_element_at("folio_list", F.lit(-1)))
        .drop("_ls")
    )


def title_of(lines: Column, profile: str = "page") -> Column:
    """Best heading among the first twelve lines, first on ties; null when none qualifies."""

    def scored(s: Column, i: Column) -> Column:
        n = F.length(s)
        if profile == "web":
            letters, upper = chars_of(s, r"\p{L}"), chars_of(s, r"\p{Lu}")
            heading = matches(s, r"^[A-Z]")
        else:
            letters, upper = chars_of(s, rf"[{P.LATIN}]"), chars_of(s, rf"[{P.LATIN_UPPER}]")
            heading = matches(s, r"^\p{Lu}")
        keep = ~matches(s, P.CONT_NOISE) & ~matches(s, r"^\d{1,4}$") & (n >= 3)
        if profile == "web":
            keep = keep & ~url_or_artifact(s) & ~(date_or_time(s) & (n <= 45))
        score = (
            F.lit(10.0)
            - i * 0.5
            + F.when(n.between(8, 60), 3.0).when(n > 80, -2.0).otherwise(0.0)
            + F.when((letters > 0) & (upper / letters > 0.7), 2.0).otherwise(0.0)
            + F.when(heading & F.contains(s, F.lit(" ")) & ~F.endswith(s, F.lit(".")), 1.5).otherwise(0.0)
        )
        return F.when(keep, F.struct(score.alias("score"), (-i).alias("at"), s.alias("text")))

    return F.array_max(F.transform(F.slice(lines, 1, 12), scored))["text"]


def titles(pages: DataFrame, text: str = "raw_text", out: str = "title", profile: str = "page") -> DataFrame:
    lines = non_empty(F.transform(text_lines(F.col(text)), strip))
    return pages.withColumn("_ls", lines).withColumn(out, title_of(F.col("_ls"), profile)).drop("_ls")


def page_features(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Everything later jobs need to know about a page; the text itself is dropped to keep shuffles small."""
    base = pages if "skip_flag" in pages.columns else pages.withColumn("skip_flag", F.lit(False))
    out = folios(S.with_text_features(base, text), text)
    out = titles(out, text)
    return (
        out.withColumn("pdf_no", label_number(F.col("label")))
        .withColumn("first_rule", S.ad_rule())
        .withColumn("is_ad", F.col("first_rule").isNotNull())
        .withColumn("is_form", S.form_ad())
        .withColumn("is_body", S.article_body())
        .withColumn("is_weak", S.weak_page())
        .drop(text)
    )


def ads_with_reasons(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Web profile with all reasons; a manual or proofread flag also makes a page an ad."""
    base = pages if "skip_flag" in pages.columns else pages.withColumn("skip_flag", F.lit(False))
    return (
        S.with_text_features(base, text)
        .withColumn("ad_reasons", S.ad_reasons())
        .withColumn("is_ad", (F.size("ad_reasons") > 0) | F.col("skip_flag"))
        .drop(text)
    )


def issue_month(path: Column) -> Column:
    """``YYYY-MM`` of the file stem or one of the last four path parts, null when none is found."""

    def found(blob: Column) -> Column:
        return F.when(
            matches(blob, P.ISSUE_DATE),
            F.concat(
                F.regexp_extract(blob, P.ISSUE_DATE, 1),
                F.lit("-"),
                F.lpad(F.regexp_extract(blob, P.ISSUE_DATE, 2), 2, "0"),
            ),
        )

    parts = non_empty(F.split(path, "/"))
    name = F.element_at(parts, -1)
    stem = F.when(matches(name, r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 3), F.lit(4))
    blob = F.concat_ws(" ", stem, F.array_join(last, " "))
    return let(blob, lambda b: F.coalesce(found(F.replace(b, F.lit(" "), F.lit("_"))), found(b)))


def toc_flag(title: Column, text: Column) -> Column:
    """Table-of-contents page by keywords in the title and the top of the text."""
    head = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(text, 1, 400)))
    return (
        F.contains(head, F.lit("in the queue"))
        | F.contains(head, F.lit("table of contents"))
        | F.contains(head, F.lit("in this issue"))
        | F.coalesce(matches(title, r"(?i)\b(?:table\s+of\s+)?contents\b"), F.lit(False))
        | matches(F.substring(text, 1, 300), r"(?i)(?:^|\n)\s*contents\s*(?:\n|$)")
    )
