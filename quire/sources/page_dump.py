"""Page dumps: ``=== label ===`` sections in a text file, as a source and as a sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.blocks import with_running_sum

PART_BYTES = 8 << 20
# Fixed format of a section header line.
HEADER = r"(?m)^===[^\S\n]*(\S.*?)[^\S\n]*===[^\S\n]*$"
PAGE_HEADER = r"(?m)^===[^\S\n]*(Page \d+)[^\S\n]*===[^\S\n]*$"
_EDGE_BLANKS = r"^\s+|\s+$"


def read_dump(docs: DataFrame, keys: Sequence[str], text: str = "text", numbered_only: bool = False) -> DataFrame:
    """Sections of each dump: ``keys, label, body``. A repeated label keeps its last body."""
    header = PAGE_HEADER if numbered_only else HEADER
    labels = F.regexp_extract_all(F.col(text), F.lit(header), F.lit(1))
    bodies = F.split(F.col(text), header, -1)
    sections = (
        docs.select(*keys, labels.alias("_l"), bodies.alias("_b"))
        .select(*keys, "_b", F.posexplode("_l").alias("_pos", "_label"))
        .select(
            *keys,
            "_pos",
            F.trim("_label").alias("label"),
            F.regexp_replace(F.element_at("_b", F.col("_pos") + 2), _EDGE_BLANKS, "").alias("body"),
        )
    )
    return sections.groupBy(*keys, "label").agg(F.max_by("body", "_pos").alias("body"))


def section(label: str, body: str) -> F.Column:  # type: ignore[name-defined]
    """One section as text; an empty page keeps its header."""
    trimmed = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), _EDGE_BLANKS, "")
    head = F.concat(F.lit("=== "), F.col(label), F.lit(" ===\n"))
    return F.when(trimmed == "", head).otherwise(F.concat(head, trimmed, F.lit("\n")))


def with_parts(
    pages: DataFrame, keys: Sequence[str], order: str, label: str, body: str, part_bytes: int = PART_BYTES, out: str = "part"
) -> DataFrame:
    """Add ``out``: which part of the dump of ``keys`` a section goes to, if a part begins after every ``part_bytes`` bytes.

    ``order`` is an integer that is unique inside a key. A part is longer than that by less than one section.
    """
    size = F.octet_length(section(label, body)).cast("long") + 1
    return with_parts_of(pages.withColumn("_size", size), keys, order, "_size", part_bytes, out).drop("_size")


def with_parts_of(pages: DataFrame, keys: Sequence[str], order: str, size: str, part_bytes: int = PART_BYTES, out: str = "part") -> DataFrame:
    """``with_parts`` by the column ``size``: bytes of each section and of the line break behind it."""
    run = with_running_sum(pages, keys, order, size, "_end")
    return run.withColumn(out, F.floor((F.col("_end") - F.col(size)) / part_bytes).cast("int")).drop("_end")


def trimmed_dump(c: F.Column) -> F.Column:  # type: ignore[name-defined]
    return F.concat(F.regexp_replace(c, _EDGE_BLANKS, ""), F.lit("\n"))


def format_dump(pages: DataFrame, keys: Sequence[str], order: str, label: str, body: str) -> DataFrame:
    """``keys, dump``: the sections of each key in order, separated by a blank line.

    A key is one row. Where an issue has no size bound, add parts (``with_parts``), or write it (``write_dump``).
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), section(label, body).alias("s"))))
    joined = F.array_join(F.transform(ordered, lambda e: e["s"]), "\n")
    return (
        pages.groupBy(*keys)
        .agg(joined.alias("dump"))
        .withColumn("dump", trimmed_dump(F.col("dump")))
    )


def write_dump(
    pages: DataFrame,
    path: str,
    issue: str = "issue_id",
    order: str = "page_no",
    label: str = "label",
    body: str = "raw_text",
    tasks: int | None = None,
) -> None:
    """Write the dump of each issue as one folder ``path/issue_id=...``, whose files in the order of their names are one text.

    Sections are range-partitioned and sorted, and stream to their file one by one: no row or task holds an issue, however long.
    """
    columns = [F.col(issue), F.col(order)]
    dealt = pages.repartitionByRange(tasks, *columns) if tasks else pages.repartitionByRange(*columns)
    rows = dealt.sortWithinPartitions(issue, order).select(issue, section(label, body).alias("value"))
    # a section ends with its own line break; the separator makes the blank line
    rows.write.partitionBy(issue).option("lineSep", "\n").mode("overwrite").text(path)


def read_dump_files(spark, path: str, folders: bool = False) -> DataFrame:  # type: ignore[no-untyped-def]
    """Sections of dump files, keyed by file path, or by folder where all files of a folder are one dump (see ``write_dump``)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    if folders:
        files = files.withColumn("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return read_dump(files, ["path"])
