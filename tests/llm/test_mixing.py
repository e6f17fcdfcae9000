"""Mixing: sizes, source sizes and targets against a count in Python."""

from __future__ import annotations

import re
from collections import Counter

from quire.llm import mixing

ROWS = [
    (1, "a", " "), (2, "a", "\n\n\t"), (3, "b", " x y \t z\r\n"), (4, None, "\x0b"), (5, None, "p q"), (6, "b", None),
    (7, "b", ""), (8, "c", "\x85w    v\x1f"), (9, "c", " " * 5000 + "u" + " " * 5000),
]


def test_white_space_holds_no_words(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in ROWS}
    source_size = Counter()
    for d, s, _ in ROWS:
        source_size[s] += size[d]
    got = {r["doc_id"]: r for r in mixing.pareto_mix(frame).collect()}
    assert {d: r["size"] for d, r in got.items()} == size
    assert {d: r["source_size"] for d, r in got.items()} == {d: source_size[s] for d, s, _ in ROWS}
    # nothing to take for a, at most three times the words of b, the rest by weight between c and the null source
    left = sum(source_size.values()) - 3 * 0
    share = {"a": 0.0, "b": left * 2 / 8, "c": left * 1 / 8, None: left * 5 / 8}
    assert {d: r["target"] for d, r in got.items()} == {d: min(share[s], 3.0 * source_size[s]) for d, s, _ in ROWS}
