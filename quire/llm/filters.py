"""Filter interaction audit: forward and backward path counting over the lattice of applied filters.

A state is the set of filters applied so far; an edge applies one more. Documents are reduced to one row per part and set of failed
filters, and these to the documents alive at every state. What an edge removes is the difference of its two ends. The number of
orders that reach a state, times the number that leave the edge's other end, counts the orders that use an edge: weighted by it,
the removals of a filter's edges add up to its Shapley sum. An order is a path, and its steps are read from the same edges.

``failed`` takes one pass over the texts; everything after it is sums of a few rows per part. Equal texts are never
gathered: each text is reduced to its smallest doc_id before rows meet.

Defined results: a null text counts as empty, a null part as the empty string (one part with it); a null doc_id has no label and no
smaller doc_id, so it never fails ``repeated``; rows that repeat doc_id and text are counted each, and don't fail because of each
other; a doc_id that is labelled twice is good, or toxic, if one of its labels says so; texts of any length are counted whole;
an empty table gives an empty result; further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

SPACE = r"[\x20\x09-\x0D]+"


def conditions(text: Column, short: int = 200, distinct: int = 50, upper: int = 2) -> dict[str, Column]:
    """Failure of each filter that a text decides alone, by its letter."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    count, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": count < short,
        "B": 100 * different.cast("long") < distinct * count,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > upper * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failed(documents: DataFrame, labels: DataFrame, rules: dict[str, Column], part: str = "source", text: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents per set of failed filters.

    Bit i of ``mask`` is the i-th of ``rules``, whose columns stand for the text column; the bit above them all marks
    texts that also belong to a smaller doc_id anywhere in ``documents``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    slim = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.sha2(body, 256).alias("key"),
        mask.cast("int").alias("mask"),
    )
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    same = ["part", "key", "mask"]
    # rows that repeat doc_id and text become one row before anything meets; rows without a doc_id are dealt by their text
    rows = materialize(slim.groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n")), "failures")
    rows = rows.withColumn("_none", F.col("doc_id").isNull()).withColumn("_at", F.coalesce("doc_id", F.xxhash64("key")))
    marks = marks.where("doc_id is not null").select(F.col("doc_id").alias("_at"), F.lit(False).alias("_none"), "good", "toxic")
    rows = rows.join(marks, ["_at", "_none"], "left")
    rows = rows.select("doc_id", *same, "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    sums = ("n", "good", "toxic")
    held = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *sums))
    per = rows.groupBy(*same).agg(
        F.min(held).alias("first"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"free_{c}") for c in sums],
    )
    # a row per part and text is left: its smallest doc_id may be the smallest of the text, all others are not
    least = per.groupBy("key").agg(F.min("first.doc_id").alias("least"))
    per = per.join(least, "key").withColumn("own", F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False)))
    passing = [F.col(f"free_{c}") + F.when(F.col("own"), F.col(f"first.{c}")).otherwise(0) for c in sums]
    one = F.struct("mask", *[x.alias(c) for x, c in zip(passing, sums, strict=True)])
    other = F.struct(
        (F.col("mask") + (1 << len(rules))).alias("mask"), *[(F.col(c) - x).alias(c) for x, c in zip(passing, sums, strict=True)]
    )
    both = per.select("part", F.explode(F.array(one, other)).alias("x")).select("part", "x.*")
    # a part stays in the table even if one of its rows counts nothing
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums])


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and orders that leave it up to the full one (by dynamic programming)."""
    states = 1 << filters
    forward, backward = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(1, states):
        forward[state] = sum(forward[state ^ (1 << i)] for i in range(filters) if state >> i & 1)
    for state in reversed(range(states - 1)):
        backward[state] = sum(backward[state | (1 << i)] for i in range(filters) if not state >> i & 1)
    return forward, backward


def alive(masks: DataFrame, filters: int) -> DataFrame:
    """part, fails (counts per set of failed filters), alive (per state: n, good, toxic of documents that pass all of its filters)."""
    states = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    empty = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    per = masks.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m")  # at most 2 ** filters entries
    )
    fails = F.transform(states, lambda s: F.coalesce(F.element_at("m", s), empty))

    def survivors(state: Column) -> Column:
        pairs = F.filter(F.map_entries("m"), lambda e: e["key"].bitwiseAND(state) == 0)
        return F.aggregate(
            pairs,
            empty,
            lambda sum_, e: F.struct(*[(sum_[c] + e["value"][c]).alias(c) for c in ("n", "good", "toxic")]),
        )

    return per.select("part", fails.alias("fails"), F.transform(states, survivors).alias("alive"))


def edges(lattice: DataFrame, letters: Sequence[str]) -> DataFrame:
    """One row per part and edge: state, filter, what the edge keeps and removes, and the filter's Shapley sum."""
    filters = len(letters)
    forward, backward = path_counts(filters)
    listed = [
        {"state": state, "next": state | 1 << i, "bit": 1 << i, "filter": letters[i], "orders": forward[state] * backward[state | 1 << i]}
        for state in range(1 << filters)
        for i in range(filters)
        if not state >> i & 1
    ]
    kind = "array<struct<state:int,next:int,bit:int,filter:string,orders:long>>"
    # the same filters * 2 ** (filters - 1) edges for every part
    out = lattice.select("*", F.explode(F.from_json(F.lit(json.dumps(listed)), kind)).alias("e"))
    here, there = F.get("alive", F.col("e.state")), F.get("alive", F.col("e.next"))
    removed = here["n"] - there["n"]
    out = out.select(
        "part",
        "e.state",
        "e.filter",
        "e.orders",
        there["n"].alias("kept"),
        removed.alias("removed"),
        (F.get("alive", F.lit(0))["n"] - F.get("alive", F.col("e.bit"))["n"] - removed).alias("redundant"),
        F.get("fails", F.col("e.bit"))["n"].alias("unique_fails"),
        (here["good"] - there["good"]).alias("good_lost"),
        (here["toxic"] - there["toxic"]).alias("toxic_lost"),
    )
    shapley = F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "filter"))  # 2 ** (filters - 1) rows each
    return out.withColumn("shapley", shapley)


def audit(masks: DataFrame, letters: Sequence[str]) -> DataFrame:
    """part, filter_order, step, filter and the figures of its edge: every step of every order of the filters."""
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "state": sum(bit[x] for x in order[:k]), "filter": order[k]}
        for order in permutations(letters)
        for k in range(len(order))
    ]
    kind = "array<struct<filter_order:string,step:int,state:int,filter:string>>"
    paths = masks.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    # filters! * filters rows whatever the documents are
    of_part = edges(alive(masks, len(letters)), letters)
    return of_part.join(F.broadcast(paths), ["state", "filter"]).drop("state", "orders")
