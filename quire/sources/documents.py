"""Readers that turn documents of many formats into titled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.entities import decoded
from quire.functions.pagination import page_array
from quire.functions.rtf import rtf_pages
from quire.functions.text import let, matches, non_empty, paragraphs, strip, sub

PAGE_TOP, PAGE_SPACE, PARA_GAP = 145, 890, 12


_SECTIONS = "array<struct<title:string,text:string,cut:boolean>>"


def _whole(text: Column, title: Column) -> Column:
    """A document as one section that is still to be paginated."""
    return F.array(F.struct(title.alias("title"), text.alias("text"), F.lit(True).alias("cut"))).cast(_SECTIONS)


def _exploded(docs: DataFrame, keys: Sequence[str], sections: Column, target_words: int = 380) -> DataFrame:
    """``keys, page_no, title, text`` from sections; every format shares this one pagination."""
    pages = F.flatten(
        F.transform(
            "_sections",
            lambda s: F.when(s["cut"], page_array(s["text"], s["title"], target_words)).otherwise(
                F.array(F.struct(s["title"].alias("title"), s["text"].alias("text")))
            ),
        )
    )
    return (
        docs.withColumn("_sections", sections)
        .select(*keys, F.posexplode(pages).alias("_pos", "_page"))
        .select(*keys, (F.col("_pos") + 1).alias("page_no"), "_page.title", "_page.text")
    )


def paginate(
    docs: DataFrame, keys: Sequence[str], text: str = "text", title: str = "title", target_words: int = 380
) -> DataFrame:
    """Readable pages of raw text."""
    return _exploded(docs, keys, _whole(F.col(text), F.col(title)), target_words)


def layout_paragraphs(pages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Paragraphs of a page as positioned lines on a sheet of 800 by 1100."""
    paras = pages.withColumn("_ps", paragraphs(F.col(text)))
    n = F.greatest(F.lit(1), F.size("_ps"))
    height = F.least(F.lit(180.0), F.greatest(F.lit(40.0), (PAGE_SPACE - n * PARA_GAP) / n))
    rows = paras.select(*keys, height.alias("_h"), F.posexplode("_ps").alias("_i", "text"))
    top = PAGE_TOP + F.col("_i") * (F.col("_h") + PARA_GAP)
    heading = (F.col("_i") == 0) & (F.length("text") < 50) & ~F.contains("text", F.lit("."))
    return rows.select(
        *keys,
        (F.col("_i") + 1).alias("line_no"),
        "text",
        F.lit(50).alias("left"),
        F.floor(top + 0.5).cast("int").alias("top"),
        F.lit(700).alias("width"),
        F.when(heading, 36).otherwise(F.floor(F.col("_h") + 0.5)).cast("int").alias("height"),
        F.lit(100).alias("confidence"),
    )


# --- Markdown (A04) ------------------------------------------------------------------------------------------------------


def plain_markdown(md: Column) -> Column:
    """Speech-ready text of Markdown source."""
    t = sub(md, r"<[^>]*>", " ")
    t = sub(t, r"!\[([^\]]*)\]\([^)]*\)", "")
    t = sub(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    t = sub(t, r"(?s)```[a-zA-Z0-9_-]*\n?(.*?)```", "$1")
    t = sub(t, r"`([^`]+)`", "$1")
    t = sub(t, r"(\*{1,3}|_{1,3})([^*_]+)\1", "$2")
    t = sub(t, r"(?md)^>\s*", "")
    t = sub(t, r"(?md)^#{1,6}\s+", "")
    t = sub(t, r"(?md)^\s*[-*+]\s+", "")
    t = sub(t, r"(?md)^\s*\d+\.\s+", "")
    t = sub(t, r"(?md)^[-*_]{3,}\s*$", "")
    return strip(sub(sub(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def markdown_sections(text: Column, title: Column) -> Column:
    """One page per ``#``/``##`` section; a document of one section is paginated."""

    def named(t: Column) -> Column:
        first = F.nullif(F.regexp_extract(t, r"(?md)^#\s+(.+)$", 1), F.lit(""))
        return F.struct(
            F.coalesce(strip(first), title).alias("title"),
            F.filter(
                F.transform(
                    F.split(t, r"(?md)(?=^#{1,2}\s+)", -1),
                    lambda s, i: F.struct(strip(s).alias("s"), (i + 1).alias("i"), (i > 0).alias("more")),
                ),
                lambda e: e["more"] | (e["s"] != ""),
            ).alias("parts"),
            t.alias("t"),
        )

    def build(d: Column) -> Column:
        def section(e: Column) -> Column:
            head = F.nullif(F.regexp_extract(e["s"], r"(?md)^#{1,2}\s+(.+)$", 1), F.lit(""))
            numbered = F.concat(d["title"], F.lit(" · Section "), e["i"].cast("string"))
            return F.struct(
                F.coalesce(strip(head), numbered).alias("title"),
                plain_markdown(e["s"]).alias("text"),
                F.lit(False).alias("cut"),
            )

        many = F.exists(d["parts"], lambda e: e["more"])
        filled = F.filter(d["parts"], lambda e: e["s"] != "")
        return F.when(many, F.transform(filled, section).cast(_SECTIONS)).otherwise(
            _whole(plain_markdown(d["t"]), d["title"])
        )

    return let(let(text, named), build)


def ingest_markdown(docs: DataFrame, keys: Sequence[str], text: str = "text", title: str = "title") -> DataFrame:
    return _exploded(docs, keys, markdown_sections(F.col(text), F.col(title)))


# --- HTML (A05) ----------------------------------------------------------------------------------------------------------

_BLOCK_OPEN = rf"(?i)<(?:{'|'.join(P.HTML_BLOCKS)})(?=[\s>/])[^>]*>"
_BLOCK_CLOSE = rf"(?i)</(?:{'|'.join(P.HTML_BLOCKS)})\s*>"


def visible_text(fragment: Column) -> Column:
    """Text of a fragment without tags, character references resolved, ends trimmed."""
    return F.trim(let(sub(fragment, r"<[^>]*>", ""), decoded), F.lit(P.WHITESPACE + P.WIDE_SPACES))


def without_containers(html: Column) -> Column:
    """Source without comments, scripts, navigation and other parts that are not read."""
    t = sub(html, r"(?s)<!--.*?(?:-->|\z)", "")
    for tag in P.HTML_DROPPED:
        t = sub(t, rf"(?is)<{tag}(?=[\s>/])[^>]*>.*?(?:</{tag}\s*>|\z)", "")
    return t


def html_sections(html: Column) -> Column:
    """Sections at ``h1``/``h2``; blocks are cut at tag boundaries, so unclosed tags do no harm."""
    blank = F.lit("")

    def blocks(section: Column) -> Column:
        pieces = F.split(section, _BLOCK_OPEN, -1)
        return non_empty(
            F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: visible_text(F.split(p, _BLOCK_CLOSE, 2)[0]))
        )

    def cleaned(t: Column) -> Column:
        doc = without_containers(t)
        # a heading without text opens no section
        for tag in ("h1", "h2"):
            doc = sub(doc, rf"(?is)<{tag}(?=[\s>/])[^>]*>\s*(?:<[^>]*>\s*)*?</{tag}\s*>", "")
        raw_title = F.regexp_extract(t, r"(?is)<title[^>]*>(.*?)</title", 1)
        heading = F.regexp_extract(t, r"(?is)<h1(?=[\s>/])[^>]*>(.*?)</h1", 1)
        name = F.coalesce(
            F.nullif(visible_text(raw_title), blank), F.nullif(visible_text(heading), blank), F.lit("Web Document")
        )
        return F.struct(name.alias("title"), doc.alias("doc"))

    def sections(d: Column) -> Column:
        parts = F.transform(
            F.split(d["doc"], r"(?i)(?=<h[12][\s>/])", -1),
            lambda s: F.struct(blocks(s).alias("b"), matches(s, r"(?i)^<h[12][\s>/]").alias("head")),
        )

        def made(ss: Column) -> Column:
            texts = F.transform(
                ss,
                lambda s: F.struct(
                    F.when(s["head"], s["b"][0]).otherwise(d["title"]).alias("title"),
                    F.array_join(s["b"], "\n\n").alias("text"),
                ),
            )
            return F.transform(
                texts,
                lambda p: F.struct(
                    p["title"].alias("title"), p["text"].alias("text"), (F.length(p["text"]) > 3500).alias("cut")
                ),
            ).cast(_SECTIONS)

        body = F.regexp_replace(d["doc"], r"(?is)^.*<body[^>]*>|<head.*?</head>", "")
        return let(
            F.filter(parts, lambda s: F.size(s["b"]) > 0),
            lambda ss: F.when(F.size(ss) > 0, made(ss)).otherwise(_whole(visible_text(body), d["title"])),
        )

    return let(let(html, cleaned), sections)


def ingest_html(docs: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    return _exploded(docs, keys, html_sections(F.col(html)))


# --- subtitles (A06) ------------------------------------------------------------------------------------------------------


def subtitle_text(text: Column) -> Column:
    """Cues of a subtitle file joined to paragraphs of more than 350 characters or up to a sentence end."""

    def spoken(line: Column) -> Column:
        t = strip(line)
        return (
            F.when(t == "", "\x00")
            .when(matches(t, r"^(?:WEBVTT|NOTE|STYLE)|^\d+$|-->"), F.lit(None))
            .otherwise(F.nullif(strip(sub(t, r"<[^>]*>", "")), F.lit("")))
        )

    kept = F.array_join(F.array_compact(F.transform(F.split(text, "\r?\n", -1), spoken)), " ")
    cues = non_empty(F.transform(F.split(kept, "\x00", -1), strip))
    state = F.struct(
        F.lit(0).alias("used"), F.lit(True).alias("fresh"), F.lit("").alias("buf"),
        F.array().cast("array<string>").alias("out"),
    )

    def step(acc: Column, cue: Column) -> Column:
        def pushed(buf: Column) -> Column:
            full = (F.length(buf) > 350) | matches(buf, r"[.!?]\z")
            return F.struct(
                F.length(buf).alias("used"),
                full.alias("fresh"),
                F.when(full, "").otherwise(buf).alias("buf"),
                F.when(full, F.concat(acc["out"], F.array(buf))).otherwise(acc["out"]).alias("out"),
            )

        return let(F.when(acc["buf"] == "", cue).otherwise(F.concat(acc["buf"], F.lit(" "), cue)), pushed)

    def closed(acc: Column) -> Column:
        return F.array_join(
            F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"]))), "\n\n"
        )

    return F.aggregate(cues, state, step, closed)


def ingest_subtitles(docs: DataFrame, keys: Sequence[str], text: str = "text", title: str = "title") -> DataFrame:
    return _exploded(docs, keys, _whole(subtitle_text(F.col(text)), F.col(title)))


# --- JSON transcripts (A07) --------------------------------------------------------------------------------------------


def _string_at(v: Column, field: str) -> Column:
    """String field of a variant, null when missing or of another type."""
    path = f"$.{field}"
    is_string = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(is_string, F.try_variant_get(v, path, "string"))


def transcript_text(json: Column) -> Column:
    """Text of a JSON transcript; broken JSON, or JSON without text, stays as it is."""
    item_keys = ("text", "content", "sentence", "message")
    object_keys = ("content", "body", "transcript", "rawText", "description", "notes")

    def item(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        fields = [F.nullif(_string_at(v, k), F.lit("")) for k in item_keys]
        return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(
            F.coalesce(*fields, F.to_json(v))
        )

    def extracted(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        top = F.nullif(strip(_string_at(v, "text")), F.lit(""))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), item)
        fields = [F.nullif(strip(_string_at(v, k)), F.lit("")) for k in object_keys]
        return (
            F.when(top.isNotNull(), top)
            .when(F.startswith(kind, F.lit("ARRAY")), F.array_join(items, "\n\n"))
            .when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(*fields, F.to_json(v)))
        )

    text = let(F.try_parse_json(json), extracted)
    return F.coalesce(F.nullif(text, F.lit("")), json)


def ingest_json(docs: DataFrame, keys: Sequence[str], json: str = "json", title: str = "title") -> DataFrame:
    return _exploded(docs, keys, _whole(transcript_text(F.col(json)), F.col(title)))


# --- delimited rows (A08) ------------------------------------------------------------------------------------------------


def delimited_text(text: Column, sep: Column) -> Column:
    """Rows as ``header: value · header: value`` paragraphs; header names may differ per file."""

    def fields(line: Column) -> Column:
        return F.transform(F.split(line, sep, -1), lambda s: sub(strip(s), "^[\"']|[\"']$", ""))

    def rows(lines: Column) -> Column:
        head = fields(lines[0])

        def row(line: Column) -> Column:
            def cells(cols: Column) -> Column:
                named = F.transform(
                    cols,
                    lambda v, i: F.concat(
                        F.coalesce(
                            F.nullif(F.get(head, i), F.lit("")), F.concat(F.lit("Col "), (i + 1).cast("string"))
                        ),
                        F.lit(": "),
                        v,
                    ),
                )
                return F.when((F.size(cols) == 1) & (cols[0] == ""), F.lit(None)).otherwise(F.array_join(named, " · "))

            return let(fields(line), cells)

        body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.array_join(F.array_compact(F.transform(body, row)), "\n\n")

    lines = F.filter(F.split(text, "\r?\n", -1), lambda s: strip(s) != F.lit(""))
    return F.coalesce(let(lines, rows), F.lit(""))


def ingest_delimited(
    docs: DataFrame, keys: Sequence[str], sep: str = ",", text: str = "text", title: str = "title"
) -> DataFrame:
    return _exploded(docs, keys, _whole(delimited_text(F.col(text), F.lit(sep)), F.col(title)))


# --- rich text (A01) ---------------------------------------------------------------------------------------------------


def rtf_sections(pages: Column, title: Column) -> Column:
    """Sections from ``rtf_pages``: page breaks of the source where it has any, else one text to be paginated."""
    titled = F.transform(
        pages,
        lambda p, i: F.struct(
            F.concat(title, F.lit(" · Page "), (i + 1).cast("string")).alias("title"), p.alias("text"), F.lit(False).alias("cut")
        ),
    )
    return F.when(F.size(pages) > 1, titled.cast(_SECTIONS)).otherwise(_whole(pages[0], title))


# --- routing (A01) -----------------------------------------------------------------------------------------------------


def file_title(path: Column) -> Column:
    """Document title of a file: its stem with underscores as blanks."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.replace(F.regexp_replace(name, r"\.[^/.]+$", ""), F.lit("_"), F.lit(" "))


def route_documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Pages of files by extension, ``path, page_no, title, text``. One pass, no shuffle, no union.

    A document without pages becomes one page with the whole text.
    """
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    t = F.col(content)
    docs = files.withColumn("_ext", ext).withColumn("_title", file_title(F.col(path)))
    # other files send a null to the rich text reader
    docs = docs.withColumn("_rtf", rtf_pages(F.when(F.col("_ext") == "rtf", t)))
    title = F.col("_title")
    plain = (
        F.when(F.col("_ext").isin("srt", "vtt"), subtitle_text(t))
        .when(F.col("_ext") == "json", transcript_text(t))
        .when(F.col("_ext") == "csv", delimited_text(t, F.lit(",")))
        .when(F.col("_ext") == "tsv", delimited_text(t, F.lit("\t")))
        .otherwise(t)
    )
    sections = (
        F.when(F.col("_ext").isin("md", "markdown"), markdown_sections(t, title))
        .when(F.col("_ext").isin("html", "htm"), html_sections(t))
        .when(F.col("_ext") == "rtf", rtf_sections(F.col("_rtf"), title))
        .otherwise(_whole(plain, title))
    )
    whole = F.when(strip(t) == "", "Empty document").otherwise(strip(t))
    return _exploded(
        docs,
        [path],
        let(sections, lambda s: F.when(F.size(s) == 0, _whole(whole, title)).otherwise(s)),
    )


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder or glob of documents of mixed formats and route them."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )
    return route_documents(files)


