"""Pagination of raw text and greedy fills inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let, non_empty, paragraphs, strip

# Fixed page marker, e.g. "=== Page 12 ===".
PAGE_MARKER = r"(?i)(?:===|---|###)\s*Page\s*(?:\d+|[IVXLCDM]+)\s*(?:===|---|###)"
WORDS_PER_PAGE = 380
_PAGE = "array<struct<title:string,text:string>>"


def greedy_starts(weights: Column, limit: int) -> Column:
    """0-based start positions of groups filled in order while the sum of weights stays within ``limit``.

    The fold keeps one small array of starts per row; its input is bounded by the size of one document.
    """
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, w: Column) -> Column:
        opens = (acc["i"] == 0) | (acc["used"] + w > limit)
        return F.struct(
            F.when(opens, w).otherwise(acc["used"] + w).alias("used"),
            (acc["i"] + 1).alias("i"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(weights, state, step, lambda acc: acc["starts"])


def slices(items: Column, starts: Column, sep: str) -> Column:
    """Joined items between consecutive start positions."""

    def cut(s: Column) -> Column:
        ends = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(items)))
        return F.transform(
            F.arrays_zip(s.alias("a"), ends.alias("b")),
            lambda e: F.array_join(F.slice(items, e["a"] + 1, e["b"] - e["a"]), sep),
        )

    return let(starts, cut)


def _titled(parts: Column, title: Column, word: str) -> Column:
    return F.transform(
        parts,
        lambda p, i: F.struct(
            F.concat(title, F.lit(f" · {word} "), (i + 1).cast("string")).alias("title"), p.alias("text")
        ),
    )


def page_array(text: Column, title: Column, target_words: int = WORDS_PER_PAGE) -> Column:
    """Pages of one text as ``array<struct<title,text>>``; the first rule that applies decides."""
    none = F.array().cast("array<string>")

    def parts(t: Column, pattern: str, present: Column) -> Column:
        return F.when(present, non_empty(F.transform(F.split(t, pattern, -1), strip))).otherwise(none)

    def titled(items: Column, name: Column, word: str) -> Column:
        return _titled(items, name, word).cast(_PAGE)

    def build(s: Column) -> Column:
        t, name, feed, marked, paras = s["t"], s["title"], s["feed"], s["marked"], s["paras"]
        few = (F.size(paras) == 0) | ((F.size(paras) <= 4) & (F.length(t) < 2500))
        counts = F.transform(paras, lambda p: F.size(F.split(p, r"\s+")))
        return (
            F.when(F.size(feed) > 1, titled(feed, name, "Part"))
            .when(F.size(marked) > 0, titled(marked, name, "Page"))
            .when(few, F.array(F.struct(name.alias("title"), strip(t).alias("text"))).cast(_PAGE))
            .otherwise(titled(slices(paras, greedy_starts(counts, target_words), "\n\n"), name, "Page"))
        )

    def split(s: Column) -> Column:
        t = s["t"]
        return F.struct(
            t.alias("t"),
            s["title"].alias("title"),
            parts(t, "\f", F.contains(t, F.lit("\f"))).alias("feed"),
            parts(t, PAGE_MARKER, F.regexp_like(t, F.lit(PAGE_MARKER))).alias("marked"),
            paragraphs(t).alias("paras"),
        )

    return let(let(F.struct(text.alias("t"), title.alias("title")), split), build)


def batch_array(text: Column, max_chars: int = 2000) -> Column:
    """Prompt-sized batches of one text: paragraphs packed up to ``max_chars``, oversize ones cut by line, then length."""
    unit = "array<struct<t:string,n:int,sep:int,over:boolean,para:int>>"

    def cut_line(line: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.length(line) - 1) / max_chars).cast("int")),
            lambda k: F.substr(line, k * max_chars + 1, F.lit(max_chars)),
        )

    def units(p: Column, i: Column) -> Column:
        pieces = F.flatten(F.transform(non_empty(F.split(p, "\n", -1)), cut_line))
        cut = F.transform(
            pieces,
            lambda s: F.struct(
                s.alias("t"), F.length(s).alias("n"), F.lit(1).alias("sep"), F.lit(True).alias("over"), i.alias("para")
            ),
        )
        whole = F.array(
            F.struct(
                p.alias("t"), F.length(p).alias("n"), F.lit(2).alias("sep"), F.lit(False).alias("over"), i.alias("para")
            )
        )
        return F.when(F.length(p) <= max_chars, whole.cast(unit)).otherwise(cut.cast(unit))

    state = F.struct(
        F.lit(0).alias("used"),
        F.lit(0).alias("i"),
        F.lit(-1).alias("para"),
        F.lit(False).alias("over"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, u: Column) -> Column:
        forced = (acc["i"] == 0) | ((acc["para"] != u["para"]) & (acc["over"] | u["over"]))
        empty = acc["used"] == 0
        opens = forced | (~empty & (acc["used"] + u["sep"] + u["n"] > max_chars))
        return F.struct(
            F.when(opens | empty, u["n"]).otherwise(acc["used"] + u["sep"] + u["n"]).alias("used"),
            (acc["i"] + 1).alias("i"),
            u["para"].alias("para"),
            u["over"].alias("over"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    def packed(us: Column) -> Column:
        starts = F.aggregate(us, state, step, lambda acc: acc["starts"])

        def batch(e: Column) -> Column:
            part = F.slice(us, e["a"] + 1, e["b"] - e["a"])
            texts = F.transform(part, lambda u: u["t"])
            # an empty paragraph at the start of a batch leaves no separator behind
            return F.when(part[0]["over"], F.array_join(texts, "\n")).otherwise(
                F.regexp_replace(F.array_join(texts, "\n\n"), r"^(?:\n\n)+", "")
            )

        def zipped(s: Column) -> Column:
            ends = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(us)))
            return F.transform(F.arrays_zip(s.alias("a"), ends.alias("b")), batch)

        return let(starts, zipped)

    def chunked(t: Column) -> Column:
        return F.when(F.length(t) <= max_chars, F.array(t)).otherwise(
            let(F.flatten(F.transform(F.split(t, "\n\n", -1), units)), packed)
        )

    return non_empty(let(strip(text), chunked))
