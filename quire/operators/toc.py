"""Table-of-contents links.

"Title occurs in the contents text" is a containment, not an equality. The seven-character substrings (grams) of the contents
texts of an issue are counted. A title can only occur where all of its grams do, so a title with an unknown gram is out, and the
others meet the texts in an equi-join on (issue, their rarest gram). Only the pairs found there are compared in full: an opening
that many titles share pairs none of them with each other's pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.noise import date_or_time, url_or_artifact
from quire.plans.blocks import with_extremes
from quire.plans.skew import join_attributes
from quire.session import materialize

GRAM = 7
PIECE = 512
_LEADER = r"(?i)(?:\b(?:page|p\.?)\s+|\.{3,}\s*)(\d+)\b"


def _grams(text: Column) -> Column:
    """Distinct seven-character substrings; the text is cut into pieces first, since ``substr`` counts from the start of its text."""
    last = F.length(text) - (GRAM - 1)
    whole = F.transform(
        F.sequence(F.lit(1), last, F.lit(PIECE)), lambda i: F.substr(text, i, F.least(F.lit(PIECE), last - i + 1) + (GRAM - 1))
    )
    inside = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (GRAM - 1)), lambda i: F.substr(p, i, F.lit(GRAM)))
    return F.when(last >= 1, F.array_distinct(F.flatten(F.transform(whole, inside)))).otherwise(F.array().cast("array<string>"))


def gram_rows(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``issue_id, keys, _gram``: one row per distinct gram, without the text."""
    return texts.select("issue_id", *keys, F.explode(_grams(F.col(text))).alias("_gram"))


def _linkable(titles: DataFrame) -> DataFrame:
    low = F.lower("title")
    return titles.filter(
        (F.length("title") > GRAM - 1) & ~date_or_time(low) & ~url_or_artifact(low)
    ).select("issue_id", "page_no", "title", low.alias("_low"))


def with_rarest_gram(titles: DataFrame, grams: DataFrame) -> DataFrame:
    """Distinct ``issue_id, _low`` of ``titles`` all of whose grams are among ``grams(issue_id, _gram)``, with the one in fewest rows.

    The grams of a title travel with a digest of it instead of the title, which may be a whole page.
    """
    counts = grams.groupBy("issue_id", "_gram").agg(F.count(F.lit(1)).alias("_k"))
    low = titles.select("issue_id", "_low").distinct().withColumn("_id", F.unhex(F.md5("_low")))
    met = join_attributes(gram_rows(low, ["_id"], "_low"), counts, ["issue_id", "_gram"])
    best = met.groupBy("issue_id", "_id").agg(
        F.min(F.struct("_k", "_gram"))["_gram"].alias("_gram"), F.bool_or(F.col("_k").isNull()).alias("_unknown")
    )
    return low.join(best.filter("NOT _unknown"), ["issue_id", "_id"]).select("issue_id", "_low", "_gram")


def toc_index(toc_pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Pages listed on some contents page of their issue; the last contents page wins.

    ``toc_pages(issue_id, page_no, raw_text)``, ``titles(issue_id, page_no, title, skip_flag)``.
    """
    contents = toc_pages.select(
        "issue_id", F.col("page_no").alias("toc_page"), F.lower("raw_text").alias("_text")
    )
    grams = materialize(gram_rows(contents, ["toc_page"], "_text"), "grams")
    pages = _linkable(titles.filter("NOT skip_flag"))
    found = (
        with_rarest_gram(pages, grams)
        .join(grams, ["issue_id", "_gram"])
        .join(contents, ["issue_id", "toc_page"])
        .filter(F.contains("_text", F.col("_low")))
    )
    # the page itself may be a contents page, so the two last contents pages are kept
    listed = with_extremes(found, ["issue_id", "_low"], "toc_page", "_tocs", k=2, largest=True)
    joined = join_attributes(pages, listed, ["issue_id", "_low"])
    others = F.filter("_tocs", lambda t: t != F.col("page_no"))
    return joined.select("issue_id", "page_no", F.try_element_at(others, F.lit(1)).alias("toc_page"), "title").filter(
        "toc_page IS NOT NULL"
    )


def toc_links(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Article page each contents chunk points to: first page whose title it holds or whose number it leads to.

    ``chunks(issue_id, page_no, chunk_no, text, is_noise)`` of contents pages.
    """
    key = ["issue_id", "toc_page", "chunk_no"]
    usable = (
        chunks.filter(~F.col("is_noise") & ~url_or_artifact(F.trim("text")) & ~date_or_time(F.trim("text")))
        .select("issue_id", F.col("page_no").alias("toc_page"), "chunk_no", F.trim("text").alias("text"))
        .withColumn("_text", F.lower("text"))
    )
    # copies of one title: its first two pages suffice, one of them may be the contents page itself
    pages = _linkable(titles)
    first_pages = with_extremes(pages, ["issue_id", "_low"], "page_no", "_pages", k=2)
    # the text joins the pairs afterwards, so that it isn't copied for each of its parts
    grams = materialize(gram_rows(usable, key[1:], "_text"), "grams")
    by_title = (
        with_rarest_gram(pages, grams)
        .join(grams, ["issue_id", "_gram"])
        .join(usable.select(*key, "_text"), key)
        .filter(F.contains("_text", F.col("_low")))
        .join(first_pages, ["issue_id", "_low"])
        .select(*key, F.explode("_pages").alias("page_no"), F.lit(1).alias("tier"))
        .filter("page_no <> toc_page")
    )
    numbers = F.transform(F.regexp_extract_all("text", F.lit(_LEADER), F.lit(1)), lambda s: F.when(s == s.try_cast("int").cast("string"), s.try_cast("int")))
    by_number = (
        usable.filter(~F.contains("_text", F.lit("continued on")))
        .select(*key, F.explode(F.array_distinct(numbers)).alias("page_no"))
        .filter("page_no <> toc_page")
        .join(titles.select("issue_id", "page_no"), ["issue_id", "page_no"])
        .select(*key, "page_no", F.lit(2).alias("tier"))
    )
    return (
        by_title.unionByName(by_number)
        .groupBy(*key)
        .agg(F.min(F.struct("page_no", "tier")).alias("_best"))
        .select(*key, F.col("_best.page_no").alias("dst_page"), F.col("_best.tier").alias("tier"))
    )
