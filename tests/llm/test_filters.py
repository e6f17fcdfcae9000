"""The audit against applying the filters in every order."""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import functions as F

from quire.llm import filters

LETTERS = "ABCDE"


def flags(rows):
    """Set of failed filters of each (doc_id, text, source) row."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        upper = len(re.findall("[A-Z]", text))
        out.append(
            "".join(
                x
                for x, bad in zip(
                    LETTERS,
                    (
                        len(words) < 6,
                        100 * len(set(words)) < 50 * len(words),
                        100 * upper > 2 * len(text),
                        bool(re.search(r"[#$%&*|]", text)),
                        doc is not None and least[text] < doc,
                    ),
                    strict=True,
                )
                if bad
            )
        )
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    failed = flags(rows)
    out = []
    for part in {s or "" for _, _, s in rows}:
        docs = [(d, f) for (d, _, s), f in zip(rows, failed, strict=True) if (s or "") == part]
        lines, total = [], dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = docs
            for k, x in enumerate(order):
                gone = [p for p in left if x in p[1]]
                left = [p for p in left if x not in p[1]]
                total[x] += len(gone)
                fails = [p for p in docs if x in p[1]]
                lines.append(
                    (part, "".join(order), k + 1, x, len(left), len(gone), len(fails) - len(gone), sum(p[1] == x for p in docs),
                     sum(p[0] in good for p in gone), sum(p[0] in toxic for p in gone))
                )
        out += [(*line, total[line[3]]) for line in lines]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def run(documents, labels):
    rules = filters.conditions(F.coalesce(F.col("text"), F.lit("")), short=6)
    return filters.audit(filters.failed(documents, labels, rules), LETTERS)


def test_audit(spark):
    plain = "some quite ordinary words follow here in a row"
    rows = [
        (1, plain, "a"), (2, plain, "a"), (3, plain, "b"), (3, plain, "b"), (None, plain, "b"), (None, plain, None), (4, None, None),
        (5, "", ""), (6, "one one one one one one one one # é", "b"), (7, "UPPER Case WORDS stand HERE now AND again $", "a"),
        (8, "\x0btab\tand\nlines of six words \x0c", "a"), (9, "word " * 4000, "a"), (10, "0", None), (11, "x" * 30_000 + " | y", "a"),
        (12, "A b c d e f g h", "only"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (6, None, 1), (7, 1, 0), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = run(docs, marks)
    assert set(got.columns) == set(COLUMNS)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute(rows, [x for x in labels if x[0] is not None])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(docs, marks).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    assert sorted(tuple(r) for r in run(one, marks).select(*COLUMNS).collect()) == brute([(1, "a", "s")], [])


def test_path_counts():
    forward, backward = filters.path_counts(5)
    assert forward[31] == backward[0] == 120
    assert all(forward[s] * backward[s] == 120 * 1 / [1, 5, 10, 10, 5, 1][bin(s).count("1")] for s in range(32))
