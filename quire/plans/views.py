"""Input views derived from the driver tables (see FIXTURES.md); every formula has an SQL twin in ``quire.checks``."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.blocks import with_seq
from quire.plans.skew import join_attributes
from quire.session import table_path

PAGE_WIDTH = 800
PAGE_HEIGHT = 1100
#: Bytes of text in one partition of pages that are cut into words: some 600,000 words, whose sorts stay in a task's memory.
WORD_BYTES = 4_000_000

# Fixed test phrases appended to documents by doc_id mod 10, so that every cleaning rule meets its own case.
FORM_PHRASES = [
    "NAME ____ ADDRESS ______ ZIP CODE ___ Total $____ e-mail __ and ______ end",
    "Balance 12,45- and 12.34+ but pages 12-14 and 1976-1977; credit 3,50− done 7.5 -",
    "I'll say you're late; they don't know what's up. He won't, Can't, It’s the boy's dog's o'clock",
    "approx. 5 ft. by 3 in. wide, etc. Dept. No. 5 ca. 1976 vs. Jan. 3\" x 6' board i.e. this",
    "The state- of-the-art mi- crocomputer and micro processor Soft ware comput ing speec h t he outpu t",
    "co m p ut er s h e l i e d Wh o th e homc timc publ ish ers d a t a and com put ers key boards",
    "Circle 123 on inquiry card. Send check to BYTE, Dept. 5\nCopyright 1976 BYTE\nAll rights reserved\nsee page 12 now",
    "| Col A | Col B |\n|-----|-----|\n~word~ com***puter syn|thesis Chapter...... [x] ██ ---\n+====+====+",
    "x7k9p brftk rkdedpiHN z80 qq zz bcz\nW;o\"r(d a,b;c:d ---- junk",
    "mi-\ncrocomputer pro- gram well \"quoted\" ‘text’ re gister Dia gram ends. Next one? (Yes) 3 more! ok",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. A scan with fewer splits than cores (a small file) is spread first, since the text jobs behind it
    are heavy on the processor; a large scan is left as it is, without a shuffle.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document; issue = source, page order = doc_id."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("issue_id"), "doc_id", F.col("text").alias("raw_text")
    )
    counts = (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("issue_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    numbered = with_seq(docs, ["issue_id"], "doc_id", "page_no")
    return join_attributes(numbered, counts, ["issue_id"]).select(
        "issue_id",
        "page_no",
        "n",
        F.concat(F.lit("Page "), F.col("page_no").cast("string")).alias("label"),
        F.lit(PAGE_WIDTH).alias("width"),
        F.lit(PAGE_HEIGHT).alias("height"),
        "raw_text",
    )


def cue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue pages with continuation cues, promotion lines and printed page numbers written into the text."""
    pages = issue_pages(spark, sf_dir)
    k = F.regexp_extract("issue_id", r"(\d+)", 1).cast("int") % 3
    pages = pages.withColumn("k", k).withColumn("printed", F.col("page_no") - F.col("k"))
    m = F.col("page_no") % 7
    pr = F.col("printed")

    def cue(words: str, number, when) -> F.Column:  # type: ignore[name-defined]
        return F.when(when & (number > 0), F.concat(F.lit(words), number.cast("string")))

    head = F.coalesce(
        cue("Continued from page ", pr - 2, m == 3),
        cue("Continued from page ", pr - 6, (m == 4) & (F.col("page_no") > 6)),
    )
    promo = F.when(
        (m == 2) & (F.col("page_no") % 2 == 0), F.lit("Buy now and save $5! Order today, limited time special offer.")
    )
    tail = F.coalesce(
        cue("Continued on page ", pr + 2, (m == 1) & (F.col("page_no") + 2 <= F.col("n"))),
        cue("Continued on page ", pr + 6, (m == 5) & (F.col("page_no") + 6 <= F.col("n"))),
    )
    folio = F.when((F.col("page_no") % 5 != 0) & (pr > 0), pr.cast("string"))
    return pages.withColumn("raw_text", F.concat_ws("\n", head, F.col("raw_text"), promo, tail, folio))


def page_lines(pages: DataFrame) -> DataFrame:
    """Non-empty trimmed lines of each page with their 1-based number."""
    trimmed = F.filter(
        F.transform(F.split("raw_text", "\n"), lambda s: F.trim(s)), lambda s: s != F.lit("")
    )
    return (
        pages.withColumn("_lines", trimmed)
        .select("*", F.posexplode("_lines").alias("_pos", "text"))
        .withColumn("line_no", F.col("_pos") + 1)
        .withColumn("n_lines", F.size("_lines"))
        .drop("_lines", "_pos", "raw_text")
    )


def pages_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue pages dealt by their key, in partitions of about ``WORD_BYTES``: the page moves once, before it is cut into rows,
    and what groups the rows of a page finds them together.
    """
    held = spark.read.parquet(table_path(sf_dir, "documents")).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, ceil(held / WORD_BYTES))
    return cue_pages(spark, sf_dir).repartition(parts, "issue_id", "page_no")


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(cue_pages(spark, sf_dir))


def positioned(pages: DataFrame) -> DataFrame:
    """Positioned lines: three columns on pages with six or more lines, one column otherwise.

    Some lines become rules (page wide or column wide) or one-word capitals so that every layout rule meets its case.
    """
    lines = page_lines(pages).drop("k", "printed", "n", "width", "height")
    ln = F.col("line_no") - 1
    c = ln % 3
    r = F.floor(ln / 3).cast("int")
    wide = F.col("n_lines") >= 6
    page_rule = wide & (F.col("page_no") % 4 == 1) & (F.col("line_no") == 7)
    box_rule = wide & (F.col("page_no") % 4 == 2) & (F.col("line_no") == 8)
    caps = (F.col("page_no") % 6 == 0) & F.col("line_no").isin(2, 3)
    text = (
        F.when(page_rule, F.lit("─" * 12))
        .when(box_rule, F.lit("-" * 8))
        .when(caps & (F.col("line_no") == 2), F.lit("SPEECH"))
        .when(caps, F.lit("SYNTHESIS"))
        .otherwise(F.col("text"))
    )
    return lines.select(
        "issue_id",
        "page_no",
        "line_no",
        text.alias("text"),
        F.when(page_rule, 40).when(wide, 40 + 200 * c).otherwise(50).cast("int").alias("left"),
        F.when(wide, 100 + 30 * r + 5 * c + F.when(r >= 4, 120).otherwise(0))
        .otherwise(145 + 24 * ln)
        .cast("int")
        .alias("top"),
        F.when(page_rule, 560).when(wide, 160).otherwise(700).cast("int").alias("width"),
        F.when(wide, 14 + 2 * (F.col("line_no") % 2)).otherwise(18).cast("int").alias("height"),
        F.col("n_lines"),
        "label",
    )


def damaged(lines: DataFrame) -> DataFrame:
    """A second, damaged reading of ``lines``."""
    text = (
        F.when(F.col("line_no") % 7 == 0, F.lit("§§§ |||"))
        .when(F.col("line_no") % 3 == 0, F.regexp_replace("text", "o", "0"))
        .otherwise(F.col("text"))
    )
    return lines.withColumn("text", text)


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, damaged reading of the layout lines."""
    return damaged(layout_lines(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word table of the layout lines; every fourth page also carries line-level rows. Rows of a page share a partition."""
    lines = positioned(pages_by_key(spark, sf_dir))
    ln = F.col("line_no") - 1
    wide = F.col("n_lines") >= 6
    # one generator for both levels: the line itself follows its words
    cut = (
        lines.withColumn("block_num", F.when(wide, ln % 3).otherwise(0).cast("int"))
        .withColumn("par_num", F.lit(0))
        .withColumn("line_num", F.when(wide, F.floor(ln / 3)).otherwise(ln).cast("int"))
        .withColumn("_w", F.filter(F.split("text", " "), lambda w: w != F.lit("")))
        .withColumn("_n", F.size("_w"))
        .withColumn("_w", F.when(F.col("page_no") % 4 == 0, F.concat("_w", F.array("text"))).otherwise(F.col("_w")))
        .select("*", F.posexplode("_w").alias("_at", "_word"))
    )
    word = F.col("_at") < F.col("_n")
    return cut.select(
        "issue_id",
        "page_no",
        "block_num",
        "par_num",
        "line_num",
        F.when(word, F.col("_at")).otherwise(0).alias("word_no"),
        F.when(word, 5).otherwise(4).alias("level"),
        F.col("_word").alias("text"),
        F.when(word, F.col("left") + 10 * F.col("_at")).otherwise(F.col("left")).alias("left"),
        "top",
        F.when(word, 9).otherwise(F.col("width")).alias("width"),
        "height",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page requests taken from the event table: any page of the issue, and numbers up to a fifth beyond its last one."""
    counts = (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("issue_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    asked = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("issue_id"), "ts"
    )
    most = F.coalesce(F.floor(F.col("n") * 6 / 5), F.lit(0))
    joined = join_attributes(asked, counts, ["issue_id"])
    return joined.select("request_id", "issue_id", (F.col("request_id") % (most + 1) + 1).cast("int").alias("number"), "ts")


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored proof results of every third page; some flagged as ads, some with a second version."""
    pages = issue_pages(spark, sf_dir).filter(F.col("page_no") % 3 == 0)
    middle = F.floor(F.length("raw_text") / 2).cast("int")
    half = F.concat(
        F.substr("raw_text", F.lit(1), middle), F.lit("\n\n"), F.substr("raw_text", middle + 1, F.length("raw_text"))
    )
    body = F.concat(F.when(F.col("page_no") % 9 == 0, F.lit("[[SKIP_AS_AD]]\n")).otherwise(F.lit("")), half)
    label = F.when(F.col("page_no") % 6 == 0, F.upper("label")).otherwise(F.col("label"))
    first = pages.select("issue_id", "page_no", label.alias("label"), body.alias("body"), F.lit(1).alias("version"))
    second = first.filter(F.col("page_no") % 12 == 0).select(
        "issue_id", "page_no", "label", F.concat(F.lit("v2 "), F.col("body")).alias("body"), F.lit(2).alias("version")
    )
    return first.unionByName(second)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one test phrase appended each."""
    phrases = F.array(*[F.lit(p) for p in FORM_PHRASES])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.col("text"), F.lit("\n"), F.element_at(phrases, (F.col("doc_id") % 10 + 1).cast("int"))
        ).alias("text"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON string per conversation: an array of turns, an object with text, or broken JSON."""
    convs = table(spark, sf_dir, "conversations")
    turns = convs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    as_array = F.to_json(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    spoken = F.array_join(F.transform("turns", lambda t: t["text"]), "\n")
    as_object = F.to_json(F.struct(spoken.alias("text")))
    broken = F.concat(F.lit("{broken "), spoken)
    return turns.select(
        "conv_id",
        F.when(F.col("conv_id") % 7 == 0, broken)
        .when(F.col("conv_id") % 5 == 0, as_object)
        .otherwise(as_array)
        .alias("json"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ordered literal pairs per issue; the second works on the output of the first."""
    issues = table(spark, sf_dir, "documents").select(F.col("source").alias("issue_id")).distinct()
    pairs = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("the ").alias("wrong"), F.lit("teh ").alias("right")),
        F.struct(F.lit(2).alias("ord"), F.lit("teh ").alias("wrong"), F.lit("THE ").alias("right")),
        F.struct(F.lit(3).alias("ord"), F.lit("de ").alias("wrong"), F.lit("DE ").alias("right")),
    )
    return issues.select("issue_id", F.inline(pairs))


def dumps(spark: SparkSession, sf_dir: str, part_bytes: int = 30_000) -> DataFrame:
    """Page-dump files: sections of an issue in page order, about ``part_bytes`` in each file."""
    from quire.sources.page_dump import format_dump, with_parts

    pages = with_parts(issue_pages(spark, sf_dir), ["issue_id"], "page_no", "label", "raw_text", part_bytes, "file_no")
    return format_dump(pages, ["issue_id", "file_no"], "page_no", "label", "raw_text").withColumnRenamed(
        "dump", "text"
    )


def toc_texts(titles: DataFrame) -> DataFrame:
    """Contents pages: page numbers with remainder 2 by 25 list the titles of the eight pages after them."""
    toc_page = F.col("page_no") - (F.col("page_no") - 2) % 25
    at = (F.col("page_no") - 2) % 25
    entry = F.when(
        at % 2 == 0, F.concat(F.lit("Story ........ "), F.col("page_no").cast("string"))
    ).otherwise(F.concat(F.lit("* "), F.coalesce("title", F.lit("untitled")), F.lit(" *")))
    return (
        titles.filter((F.col("page_no") >= 2) & at.between(1, 8))
        .groupBy("issue_id", toc_page.alias("page_no"))
        .agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), entry.alias("entry")))).alias("_e"))
        .select(
            "issue_id",
            "page_no",
            F.concat(
                F.lit("Table of Contents\n"), F.array_join(F.transform("_e", lambda e: e["entry"]), "\n")
            ).alias("raw_text"),
        )
    )
