"""Line tables from word tables, text-layer spans and pairs of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.cleaning import core_repair_steps, dehyphenate
from quire.functions.joining import joined_lines
from quire.functions.scores import junk_text, word_score
from quire.functions.text import let, non_empty, strip, sub

PAGE = ["issue_id", "page_no"]


def page_range(
    pages: DataFrame, start: int = 1, end: int | None = None, offset: int = 0, order: str = "page_no"
) -> DataFrame:
    """Pages of a 1-based inclusive range; printed numbers are shifted by ``offset``. The filter reaches the scan."""
    first = max(1, start + offset)
    if end is None:
        return pages.filter(F.col(order) >= first)
    if end + offset < first:
        raise ValueError(f"empty page range {start}..{end}")
    return pages.filter(F.col(order).between(first, end + offset))


def assemble_lines(words: DataFrame) -> DataFrame:
    """Line-level rows of a page where it has any, otherwise its words grouped to lines with their union box."""
    solid = words.filter((strip(F.col("text")) != "") & (F.col("width") > 0) & (F.col("height") > 0)).filter(
        F.col("level").isin(4, 5)
    )
    page = Window.partitionBy(*PAGE)
    picked = solid.withColumn("_has4", F.max((F.col("level") == 4).cast("int")).over(page)).filter(
        F.col("level") == F.when(F.col("_has4") == 1, 4).otherwise(5)
    )
    group = [*PAGE, "block_num", "par_num", "line_num", "level"]
    texts = F.array_sort(F.collect_list(F.struct("word_no", strip(F.col("text")).alias("t"))))
    lines = picked.groupBy(*group).agg(
        F.array_join(F.transform(texts, lambda e: e["t"]), " ").alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
    )
    order = page.orderBy("block_num", "par_num", "line_num")
    return lines.withColumn("line_no", F.row_number().over(order)).select(
        *PAGE, "line_no", "text", "left", "top", "width", "height"
    )


def assemble_spans(spans: DataFrame) -> DataFrame:
    """A12, web profile: spans of one baseline joined while the gap stays small; a wide gap opens a new line.

    ``spans(issue_id, page_no, span_no, text, x0, x1, y0, y1, font)``.
    """
    by_top = Window.partitionBy(*PAGE).orderBy("y0", "x0", "span_no")
    up_to = (Window.unboundedPreceding, Window.currentRow)
    jump = F.col("y0") - F.lag("y0").over(by_top) > 0.6 * F.least("font", F.lag("font").over(by_top))
    banded = (
        spans.filter(strip(F.col("text")) != "")
        .withColumn("_j", F.coalesce(jump.cast("int"), F.lit(0)))
        .withColumn("_band", F.sum("_j").over(by_top.rowsBetween(*up_to)))
    )
    in_band = Window.partitionBy(*PAGE, "_band").orderBy("x0", "span_no")
    gap = F.col("x0") - F.lag("x1").over(in_band)
    reach = F.greatest(F.lit(28.0), 2.2 * F.greatest("font", F.lag("font").over(in_band)))
    cut = ~F.coalesce(gap.between(F.lit(-4), reach), F.lit(False))
    islands = banded.withColumn("_cut", cut.cast("int")).withColumn(
        "_island", F.sum("_cut").over(in_band.rowsBetween(*up_to))
    )
    texts = F.array_sort(F.collect_list(F.struct("x0", "span_no", "text")))
    lines = islands.groupBy(*PAGE, "_band", "_island").agg(
        F.array_join(F.transform(texts, lambda e: e["text"]), " ").alias("text"),
        F.min("x0").alias("_x0"),
        F.max("x1").alias("_x1"),
        F.min("y0").alias("_y0"),
        F.max("y1").alias("_y1"),
    )
    order = Window.partitionBy(*PAGE).orderBy("_band", "_island")
    zero = F.lit(0)
    return lines.select(
        *PAGE,
        F.row_number().over(order).alias("line_no"),
        strip(F.col("text")).alias("text"),
        F.greatest(zero, F.col("_x0")).alias("left"),
        F.greatest(zero, F.col("_y0")).alias("top"),
        F.greatest(F.lit(16), F.col("_x1") - F.col("_x0")).alias("width"),
        F.greatest(F.lit(14), F.col("_y1") - F.col("_y0")).alias("height"),
    )


def assemble_blocks(fragments: DataFrame, dpi: int = 250) -> DataFrame:
    """A12, page profile: fragments to lines with space rules, lines of a block to one paragraph, boxes scaled to ``dpi``.

    ``fragments(issue_id, page_no, block_no, line_no, span_no, text, x0, y0, x1, y1)`` in points.
    """
    scale = dpi / 72.0
    parts = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    glued = F.array_join(F.transform(parts, lambda e: e["text"]), "\x00")
    spaced = sub(sub(glued, r"(?<=[\p{L}\p{N}])\x00(?=[\p{L}\p{N}])", " "), r"\x00", "")
    lines = (
        fragments.filter(F.col("text") != "")
        .groupBy(*PAGE, "block_no", "line_no")
        .agg(
            strip(spaced).alias("text"),
            F.min("x0").alias("x0"),
            F.min("y0").alias("y0"),
            F.max("x1").alias("x1"),
            F.max("y1").alias("y1"),
        )
        .filter("text <> ''")
    )
    blocks = lines.groupBy(*PAGE, "block_no").agg(
        joined_lines(F.struct("line_no", F.col("text").alias("t"))).alias("text"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )
    whole = lambda c: F.bround(c * scale).cast("int")
    return blocks.select(
        *PAGE,
        F.col("block_no").alias("line_no"),
        "text",
        whole(F.col("x0")).alias("left"),
        whole(F.col("y0")).alias("top"),
        F.greatest(F.lit(1), whole(F.col("x1") - F.col("x0"))).alias("width"),
        F.greatest(F.lit(1), whole(F.col("y1") - F.col("y0"))).alias("height"),
    )


# --- two readings of one page --------------------------------------------------------------------------------------------


def better_word(a: Column, b: Column) -> Column:
    """The cleaner of two tokens at one position; close scores are decided by length, then for the first source."""

    def chosen(s: Column) -> Column:
        close = F.abs(s["a"] - s["b"]) < 1.0
        return F.when(close, F.when(F.length(a) >= F.length(b), a).otherwise(b)).otherwise(
            F.when(s["a"] >= s["b"], a).otherwise(b)
        )

    return (
        F.when(a == "", b)
        .when((b == "") | (a == b), a)
        .otherwise(let(F.struct(word_score(a).alias("a"), word_score(b).alias("b")), chosen))
    )


def _words(c: Column) -> Column:
    return non_empty(F.split(strip(c), r"\s+"))


def _merged_text(a: Column, b: Column) -> Column:
    empty = F.lit("")
    return F.array_join(
        F.zip_with(a, b, lambda x, y: better_word(F.coalesce(x, empty), F.coalesce(y, empty))), " "
    )


def merge_sources(text_lines: DataFrame, ocr_lines: DataFrame, mode: str = "prefer") -> DataFrame:
    """Lines of each page from a text layer and a scan reading.

    ``prefer`` text layer where it has any line, else scan; ``text_only`` the same with the text layer's name; ``force_ocr``
    scan only; ``merge`` pairs readable lines by position in the page and keeps the better words or the better line.
    """
    cols = [*PAGE, "line_no", "text", "left", "top", "width", "height"]
    text_lines, ocr_lines = text_lines.select(cols), ocr_lines.select(cols)
    if mode == "force_ocr":
        return ocr_lines.withColumn("source_kind", F.lit("OCR"))
    if mode in ("prefer", "text_only"):
        rest = ocr_lines.join(text_lines.select(*PAGE).distinct(), PAGE, "left_anti")
        return text_lines.withColumn("source_kind", F.lit("PDF")).unionByName(
            rest.withColumn("source_kind", F.lit("OCR"))
        )
    values = ("text", "left", "top", "width", "height")

    def side(lines: DataFrame, name: str) -> DataFrame:
        """Readable lines of a page in order, as one row: lines that are dealt by their page are not dealt again."""
        readable = lines.filter(~junk_text(F.col("text")))
        line = F.struct("line_no", *values, _words(F.col("text")).alias("w"))
        return readable.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias(name))

    pages = side(text_lines, "a").join(side(ocr_lines, "b"), PAGE, "full_outer")
    # the shorter reading of a page, or a missing one, is filled up with nulls
    pairs = F.arrays_zip(F.coalesce("a", F.array()).alias("a"), F.coalesce("b", F.array()).alias("b"))
    both = pages.select(*PAGE, F.posexplode(pairs).alias("_at", "_pair")).select(
        *PAGE, (F.col("_at") + 1).alias("line_no"), F.col("_pair.a").alias("a"), F.col("_pair.b").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    near = F.abs(a["top"] - b["top"]) <= F.greatest(a["height"], b["height"]) * 2.0
    left, top = F.least(a["left"], b["left"]), F.least(a["top"], b["top"])
    merged = F.struct(
        _merged_text(a["w"], b["w"]).alias("text"),
        left.alias("left"),
        top.alias("top"),
        F.greatest(F.lit(1), F.greatest(a["left"] + a["width"], b["left"] + b["width"]) - left).alias("width"),
        F.greatest(F.lit(1), F.greatest(a["top"] + a["height"], b["top"] + b["height"]) - top).alias("height"),
    )
    total = lambda w: F.aggregate(F.transform(w, word_score), F.lit(0.0), lambda s, x: s + x)
    plain = lambda c: F.struct(*[c[f].alias(f) for f in values])
    picked = (
        F.when(b.isNull(), plain(a))
        .when(a.isNull(), plain(b))
        .when(near, merged)
        .when(total(a["w"]) >= total(b["w"]), plain(a))
        .otherwise(plain(b))
    )
    kind = F.when(b.isNull(), "PDF").when(a.isNull(), "OCR").otherwise("PDF+OCR")
    # one generator over the merged line: the filter behind it does not merge the words a second time
    kept = F.filter(F.array(picked), lambda m: ~junk_text(m["text"]))
    return both.select(*PAGE, "line_no", kind.alias("source_kind"), F.inline(kept)).select(
        *PAGE, "line_no", "text", "left", "top", "width", "height", "source_kind"
    )


def merge_audit(text_lines: DataFrame, ocr_lines: DataFrame, alternatives: bool = False) -> DataFrame:
    """Per page the chosen tokens with source tags, and how many words came from each source."""

    def side(lines: DataFrame, name: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
        page = lines.groupBy(*PAGE).agg(F.array_join(F.transform(texts, lambda e: e["text"]), "\n").alias("_t"))
        page = page.withColumn("_t", sub(F.replace(strip(F.col("_t")), F.lit("­"), F.lit("-")), r"\s*[-–—]\s*", "-"))
        for step in [dehyphenate, *core_repair_steps()]:
            page = page.withColumn("_t", step(F.col("_t")))
        return page.select(*PAGE, _words(F.col("_t")).alias(name))

    both = side(text_lines, "a").join(side(ocr_lines, "b"), PAGE, "full_outer")
    none = F.array().cast("array<string>")

    def tagged(x: Column, y: Column) -> Column:
        a, b = F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))

        def choice(best: Column) -> Column:
            pdf = best == a
            tag = F.when(pdf, "PDF").otherwise("OCR")
            label = F.concat(tag, F.lit(":"), best)
            if alternatives:
                label = F.concat(F.lit("PDF:"), a, F.lit(" / OCR:"), b, F.lit(" -> "), best)
            return F.struct(tag.alias("source"), label.alias("token"))

        return (
            F.when(a == "", F.struct(F.lit("OCR").alias("source"), F.concat(F.lit("OCR:"), b).alias("token")))
            .when(b == "", F.struct(F.lit("PDF").alias("source"), F.concat(F.lit("PDF:"), a).alias("token")))
            .when(a == b, F.struct(F.lit("same").alias("source"), a.alias("token")))
            .otherwise(let(better_word(a, b), choice))
        )

    zipped = both.select(
        *PAGE, F.zip_with(F.coalesce("a", none), F.coalesce("b", none), tagged).alias("_z")
    )
    count = lambda s: F.size(F.filter("_z", lambda e: e["source"] == s))
    return zipped.select(
        *PAGE,
        F.array_join(F.transform("_z", lambda e: e["token"]), " ").alias("tokens"),
        count("PDF").alias("from_pdf"),
        count("OCR").alias("from_ocr"),
        count("same").alias("same"),
    )
