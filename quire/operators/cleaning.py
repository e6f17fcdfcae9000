"""Corpus text cleaning (C01-C24): each job rewrites one text column.

A job is a list of steps; every step is one projection over the column the step before wrote. Catalyst keeps them in one
stage, and a step that reads its input twice does not copy the steps before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import cleaning as C
from quire.functions import noise as N
from quire.functions.joining import join_text, joined_lines
from quire.functions.text import matches, strip
from quire.plans.skew import join_attributes

Step = Callable[[Column], Column]


def apply_steps(df: DataFrame, col: str, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.withColumn(col, step(F.col(col)))
    return df


def join_lines(lines: DataFrame, keys: Sequence[str], order: str = "line_no", text: str = "text") -> DataFrame:
    """One paragraph per key from its lines in order."""
    return lines.groupBy(*keys).agg(joined_lines(F.struct(F.col(order), F.col(text).alias("t"))).alias(text))


def dehyphenate(df: DataFrame, col: str = "text", profile: str = "page") -> DataFrame:
    """Inline dehyphenation; the page profile goes on with the split-word repair."""
    steps: list[Step] = [lambda c: C.dehyphenate(c, profile)]
    if profile == "page":
        steps += C.core_repair_steps()
    return apply_steps(df, col, steps)


def repair_words(df: DataFrame, col: str = "text", level: str = "core") -> DataFrame:
    """C03 (``core``) and C04 (``extended``): repair of words split by the scanner."""
    return apply_steps(df, col, C.core_repair_steps() if level == "core" else C.extended_repair_steps())


def merge_syllables(df: DataFrame, col: str = "text") -> DataFrame:
    """C05."""
    return apply_steps(df, col, [C.merge_syllables])


def merge_fragments(df: DataFrame, col: str = "text") -> DataFrame:
    """C06."""
    return apply_steps(df, col, [C.single_blanks, C.merge_fragments])


def expand_form_blanks(df: DataFrame, col: str = "text", generic: str = " ") -> DataFrame:
    """C07."""
    return apply_steps(df, col, [lambda c: C.form_blanks(c, generic)])


def normalize_signs(df: DataFrame, col: str = "text") -> DataFrame:
    """C08."""
    return apply_steps(df, col, [C.signs])


def expand_contractions(df: DataFrame, col: str = "text") -> DataFrame:
    """C09."""
    return apply_steps(df, col, [C.contractions])


def expand_abbreviations(df: DataFrame, col: str = "text") -> DataFrame:
    """C10."""
    return apply_steps(df, col, [C.abbreviations, C.number_abbreviations])


def strip_quotes(df: DataFrame, col: str = "text", profile: str = "page") -> DataFrame:
    """C11."""
    return apply_steps(df, col, [lambda c: C.quotes(c, profile)])


def normalize_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Text for a speech corpus; rows that are garbage in the end become empty."""
    steps: list[Step] = [
        C.speech_lines,
        join_text,
        lambda c: C.dehyphenate(c),
        *C.core_repair_steps(),
        C.form_blanks,
        C.abbreviations,
        C.number_abbreviations,
        C.contractions,
        C.quotes,
        lambda c: F.when(N.garbage(c), "").otherwise(c),
    ]
    return apply_steps(df, col, steps)


def clean_tokens(df: DataFrame, col: str = "text") -> DataFrame:
    """C15."""
    return apply_steps(df, col, [C.clean_tokens])


def remove_table_noise(df: DataFrame, col: str = "text") -> DataFrame:
    """C16."""
    return apply_steps(df, col, [C.table_noise])


def strip_boilerplate(df: DataFrame, col: str = "text") -> DataFrame:
    """C17."""
    return apply_steps(df, col, [C.boilerplate])


def clean_ocr(df: DataFrame, col: str = "text") -> DataFrame:
    """Full cleaner of scanned text; also the rule-based stand-in for a proofreading model."""
    steps: list[Step] = [
        C.scan_symbols,
        C.boilerplate,
        C.spaced_letters,
        *C.extended_repair_steps(),
        C.readable_lines,
    ]
    return apply_steps(df, col, steps)


def clean_for_speech(df: DataFrame, col: str = "text") -> DataFrame:
    """C20: web speech text; empty where nothing can be spoken."""
    speakable: Step = lambda c: F.when(matches(c, r"[\p{L}0-9]"), c).otherwise("")
    steps: list[Step] = [
        lambda c: F.when(N.table_line(c), "").otherwise(c),
        C.table_noise,
        speakable,
        *C.extended_repair_steps(),
        C.form_blanks,
        C.signs,
        C.contractions,
        C.abbreviations,
        C.number_abbreviations,
        lambda c: C.quotes(c, "web"),
        C.clean_tokens,
        lambda c: strip(F.regexp_replace(c, r"[ \t]{2,}", " ")),
        speakable,
    ]
    return apply_steps(df, col, steps)


def clean_audit(df: DataFrame, col: str, jobs: dict[str, Callable[[DataFrame, str], DataFrame]]) -> DataFrame:
    """Rows changed and characters removed by each job, ``rule, rows, rows_changed, chars_removed``; one pass."""
    names = list(jobs)
    out = df.select(F.col(col).alias("_src"))
    for i, name in enumerate(names):
        out = jobs[name](out.withColumn(f"_r{i}", F.col("_src")), f"_r{i}")
    sums = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(names)):
        sums.append(F.count_if(F.col(f"_r{i}") != F.col("_src")).alias(f"_c{i}"))
        sums.append(F.sum(F.length("_src") - F.length(f"_r{i}")).alias(f"_d{i}"))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col("rows"),
                F.col(f"_c{i}").alias("rows_changed"),
                F.col(f"_d{i}").alias("chars_removed"),
            )
            for i, name in enumerate(names)
        ]
    )
    return out.agg(*sums).select(F.inline(entries))


def counted_rules(
    df: DataFrame, rules: Sequence[C.Rule], col: str = "text", hits: str = "hits", needed: str | None = None
) -> DataFrame:
    """Apply ordered ``rules`` to ``col``; ``hits`` is an ``array<struct<rule, n>>`` of what each replaced.

    Two columns a rule, one reading what the rule before wrote; rows in which a pattern does not occur keep their text object.
    Rows that hold no match of ``needed``, which stands where any rule matches a text that no rule has changed, have no hits.
    """
    kept = [c for c in df.columns if c != col]
    if needed is not None:
        df = df.withColumn("_any", F.regexp_like(col, F.lit(needed)))
    for i, (_, pattern, replacement) in enumerate(rules):
        n = F.regexp_count(col, F.lit(pattern))
        n = n if needed is None else F.when(F.col("_any") | F.col(col).isNull(), n).otherwise(0)
        df = df.select(*[c for c in df.columns if c != col], col, n.alias(f"_n{i}"))
        text = F.when(F.col(f"_n{i}") > 0, F.regexp_replace(col, F.lit(pattern), F.lit(replacement))).otherwise(F.col(col))
        df = df.withColumn(col, text)
    listed = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_n{i}").alias("n")) for i, (name, _, _) in enumerate(rules)])
    return df.select(*kept, col, listed.alias(hits))


def rule_hits(df: DataFrame, col: str = "text") -> DataFrame:
    """``pack, rule, pages_hit, replacements`` of every rule of the packs that are lists of rules or tables of words."""
    packs = {"form_blanks": C.form_rules(), "boilerplate": C.boilerplate_rules(), "quotes": C.quote_rules()}
    tables = {"contractions": C.contraction_hits, "abbreviations": C.abbreviation_hits}
    kind = "array<struct<rule:string,n:int>>"
    text = df.select(F.col(col).alias("text"))
    needed = {"form_blanks": "__", "boilerplate": C.boilerplate_needed(), "quotes": "[\"']"}
    parts = [counted_rules(text, rules, needed=needed[name]).select(F.lit(name).alias("pack"), F.inline(F.col("hits").cast(kind))) for name, rules in packs.items()]
    parts += [text.select(F.lit(name).alias("pack"), F.inline(hits(F.col("text")).cast(kind))) for name, hits in tables.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.filter("n > 0").groupBy("pack", "rule").agg(
        F.count(F.lit(1)).alias("pages_hit"), F.sum("n").alias("replacements")
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, col: str = "text") -> DataFrame:
    """Ordered literal replacements of each issue. Rows of an issue without corrections pass unchanged."""
    pairs = corrections.groupBy("issue_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "wrong", "right"))).alias("_pairs")
    )
    joined = join_attributes(df, pairs, ["issue_id"])
    fixed = F.aggregate("_pairs", F.col(col), lambda t, p: F.replace(t, p["wrong"], p["right"]))
    return joined.withColumn(col, F.when(F.col("_pairs").isNull(), F.col(col)).otherwise(fixed)).drop("_pairs")
