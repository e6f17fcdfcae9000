"""Joining lines into paragraphs with dehyphenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import non_empty, rstrip, strip, sub

_CONNECTOR = rf"(?i:{'|'.join(P.CONNECTORS)}){P.WE}"
_HYPHEN = "[\\-\u00ad]"


def join_text(lines_text: Column) -> Column:
    """Join the newline-separated lines of one text. Every decision looks at a single line boundary only."""
    lines = F.transform(
        F.filter(F.split(lines_text, "\n", -1), lambda s: strip(s) != F.lit("")), lambda s: rstrip(s)
    )
    t = F.array_join(lines, "\n")
    # closing punctuation or an apostrophe glues without a blank
    t = sub(t, r"\n\s*(?=[.,;:!?%)\]}'’])", "")
    # end-of-line hyphen before lower case: drop it, unless a compound connector follows
    t = sub(t, rf"(?<=[{P.W}]){_HYPHEN}\n\s*(?=\p{{Ll}})(?!{_CONNECTOR})", "")
    # capital or connector: keep one plain hyphen
    t = sub(t, rf"(?<=[{P.W}]){_HYPHEN}\n\s*(?=\p{{L}})", "-")
    return strip(sub(t, r"\n\s*", " "))


def joined_lines(ordered: Column) -> Column:
    """Aggregate: join the ``t`` fields of ``(order, t)`` structs in order."""
    texts = F.transform(F.array_sort(F.collect_list(ordered)), lambda e: e["t"])
    return join_text(F.array_join(texts, "\n"))
