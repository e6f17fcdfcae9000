"""Advertising inserts between pages of an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.links import landing_chunk, with_offset
from quire.plans.blocks import with_leads, with_nearest, with_seq

PAGE = ["issue_id", "page_no"]
_SEEN = [
    "page_no", "pdf_no", "continued_from", "is_ad", "is_form", "is_weak", "is_body", "skip_flag", "chars", "prose",
]


def _names(numbers: Column, number: Column) -> Column:
    return F.coalesce(F.array_contains(numbers, number), F.lit(False))


def ad_skips(features: DataFrame, chunks: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Pages i whose next page is an insert and whose story goes on at i+2.

    ``issue_id, src_page, ad_page, dst_page, source, dst_chunk``. Printed numbers in cues are compared after taking off the
    page offset (``offsets=None`` compares with physical numbers).
    """
    cols = [*_SEEN, "issue_id", "continued_on"]
    pages = with_seq(with_offset(features.select(*cols), offsets), ["issue_id"], "page_no", "_seq")
    df = with_leads(pages, ["issue_id"], "_seq", _SEEN, 2)
    ad, cont = F.col("next1"), F.col("next2")
    printed = F.col("pdf_no") - F.col("page_offset")
    has_from = F.size(cont["continued_from"]) > 0
    named = _names(cont["continued_from"], printed)
    linked = named | _names(F.col("continued_on"), cont["pdf_no"] - F.col("page_offset"))
    insert = F.coalesce(
        (ad["pdf_no"] == F.col("pdf_no") + 1) & (cont["pdf_no"] == F.col("pdf_no") + 2), F.lit(False)
    )
    insert_like = ad["is_ad"] | ad["is_form"] | ad["is_weak"] | ad["skip_flag"]
    resumes = cont["is_body"] | has_from
    goes_on = (
        named
        | (has_from & ad["is_ad"])
        | (insert & insert_like & resumes)
        | (insert_like & cont["is_body"] & (insert | printed.isNotNull()))
        | ((ad["is_form"] | ad["skip_flag"]) & cont["is_body"])
        | ((ad["is_ad"] | ad["is_form"]) & resumes)
    )
    long_prose = (ad["chars"] > 500) & (ad["prose"] >= 0.4)
    skippable = insert_like | named | (insert & has_from & ~ad["is_body"] & ~long_prose)
    found = df.filter(
        cont.isNotNull() & (F.size(ad["continued_from"]) == 0) & linked & goes_on & skippable
    ).select(
        "issue_id",
        F.col("page_no").alias("src_page"),
        ad["page_no"].alias("ad_page"),
        cont["page_no"].alias("dst_page"),
        printed.alias("source"),
    )
    return landing_chunk(found, chunks)


def _like_ad() -> Column:
    return F.col("is_ad") | F.col("is_form") | F.col("skip_flag")


def ad_runs(features: DataFrame, skips: DataFrame) -> DataFrame:
    """Skipped pages with the run they belong to and the page where reading resumes.

    ``issue_id, page_no, run_page, resume_page``. A run is a stretch of pages that look like ads, or that E06 marks as
    inserts, reached from a page that is read. A single last page is read, not skipped. ``resume_page`` is null when the
    issue ends inside the run.
    """
    targets = skips.select("issue_id", F.col("ad_page").alias("page_no"), F.lit(True).alias("_target"))
    pages = (
        with_seq(features.select(*PAGE, _like_ad().alias("_ad")), ["issue_id"], "page_no", "_seq")
        .join(targets, PAGE, "left")
        .withColumn("_weak", F.coalesce("_target", F.lit(False)) & ~F.col("_ad"))
        .withColumn("_plain", ~F.col("_weak"))
    )
    # a weak insert skipped from the page before is not itself a page that skips: every second one counts
    pages = with_nearest(pages, ["issue_id"], "_seq", "_plain", prev_out="_before")
    odd = (F.col("_seq") - F.coalesce("_before", F.lit(0))) % 2 == 1
    pages = pages.withColumn("_out", F.col("_ad") | (F.col("_weak") & odd)).withColumn("_read", ~F.col("_out"))
    pages = with_nearest(pages, ["issue_id"], "_seq", "_read", prev_out="_prev", next_out="_next")
    first = F.when(F.col("_prev").isNull(), F.lit(2)).otherwise(F.col("_prev") + 1)
    pages = with_leads(pages, ["issue_id"], "_seq", ["page_no"], 1)
    runs = pages.filter(F.col("_out") & (F.col("_seq") >= first)).withColumn("_first", first)
    # the page after the first page of a run must exist, otherwise the run is the last page and is read
    runs = runs.filter(~((F.col("_seq") == F.col("_first")) & F.col("next1").isNull()))
    numbers = pages.select("issue_id", "_seq", "page_no")
    return (
        runs.select(*PAGE, "_first", "_next")
        .join(
            numbers.select("issue_id", F.col("_seq").alias("_first"), F.col("page_no").alias("run_page")),
            ["issue_id", "_first"],
        )
        .join(
            numbers.select("issue_id", F.col("_seq").alias("_next"), F.col("page_no").alias("resume_page")),
            ["issue_id", "_next"],
            "left",
        )
        .select(*PAGE, "run_page", "resume_page")
    )


def ad_queue(features: DataFrame, runs: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Every known ad page once, skipped or stand-alone, with its printed number."""
    known = (
        features.filter(_like_ad())
        .select(*PAGE)
        .unionByName(runs.select(*PAGE))
        .dropDuplicates(PAGE)
        .join(runs.select(*PAGE).withColumn("_s", F.lit(True)), PAGE, "left")
        .withColumn("skipped", F.coalesce("_s", F.lit(False)))
        .drop("_s")
    )
    numbers = with_offset(features.select(*PAGE, "pdf_no"), offsets)
    printed = F.greatest(F.lit(0), F.coalesce("pdf_no", "page_no") - F.col("page_offset"))
    return known.join(numbers, PAGE).select(*PAGE, "skipped", printed.alias("printed"))
