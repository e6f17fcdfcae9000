"""Block-wise order operations against brute force, with blocks far smaller than the keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.plans.blocks import (
    with_extremes,
    with_leads,
    with_nearest,
    with_running_sum,
    with_seq,
    with_sorted_seq,
)
from quire.plans.closure import closure
from quire.plans.skew import join_attributes
from quire.session import materialize

BLOCK = 4


def _rows(seed: int = 7) -> list[tuple[str, int, bool, int]]:
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 60), ("cold", 5), ("one", 1)):
        for at in sorted(rng.sample(range(1, 200), n)):
            rows.append((key, at, rng.random() < 0.3, rng.randint(0, 9)))
    return rows


def test_positions_and_running_sum(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, at int, flag boolean, v int")
    got = {
        (r.k, r.at): (r.seq, r.total)
        for r in with_running_sum(with_seq(df, ["k"], "at", "seq", BLOCK), ["k"], "at", "v", "total", BLOCK).collect()
    }
    for key in ("hot", "cold", "one"):
        total = 0
        for i, r in enumerate([r for r in rows if r[0] == key], start=1):
            total += r[3]
            assert got[(key, r[1])] == (i, total)


def test_leads_reach_over_block_ends(spark):
    rows = _rows()
    df = with_seq(spark.createDataFrame(rows, "k string, at int, flag boolean, v int"), ["k"], "at", "seq", BLOCK)
    out = with_leads(df, ["k"], "seq", ["at"], 2, BLOCK).collect()
    assert len(out) == len(rows)
    for r in out:
        line = [x[1] for x in rows if x[0] == r.k]
        i = line.index(r.at)
        assert (r.next1.at if r.next1 else None) == (line[i + 1] if i + 1 < len(line) else None)
        assert (r.next2.at if r.next2 else None) == (line[i + 2] if i + 2 < len(line) else None)


def test_nearest_flagged_row(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "k string, at int, flag boolean, v int")
    for r in with_nearest(df, ["k"], "at", "flag", "before", "after", BLOCK).collect():
        flagged = [x[1] for x in rows if x[0] == r.k and x[2]]
        assert r.before == max([a for a in flagged if a < r.at], default=None)
        assert r.after == min([a for a in flagged if a > r.at], default=None)


def test_extremes_and_sorted_positions(spark):
    rows = _rows(5)
    df = spark.createDataFrame(rows, "k string, at int, flag boolean, v int")
    small = {r.k: r.x for r in with_extremes(df, ["k"], "at", "x", 2, block=BLOCK).collect()}
    large = {r.k: r.x for r in with_extremes(df, ["k"], "at", "x", 2, largest=True, block=BLOCK).collect()}
    for key in small:
        values = sorted(x[1] for x in rows if x[0] == key)
        assert small[key] == values[:2]
        assert large[key] == values[::-1][:2]
    named = df.withColumn("name", F.md5(F.col("at").cast("string")))
    for key in small:
        got = [r for r in with_sorted_seq(named, ["k"], ["name"], "pos", "n").filter(F.col("k") == key).collect()]
        assert [r.pos for r in sorted(got, key=lambda r: r.name)] == list(range(1, len(got) + 1))
        assert {r.n for r in got} == {len(got)}


def test_attribute_join_keeps_all_rows(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 80, "hot").otherwise("cold").alias("k"), "id")
    attrs = spark.createDataFrame([("hot", "H"), ("cold", "C")], "k string, v string")
    got = join_attributes(rows, attrs, ["k"])
    assert got.count() == 100
    assert {(r.k, r.v) for r in got.collect()} == {("hot", "H"), ("cold", "C")}
    lost = join_attributes(rows, attrs.filter("k = 'hot'"), ["k"])
    assert lost.filter("v IS NULL").count() == 20


def _distances(links, start):
    found, todo = {start: 0}, [start]
    for here in todo:
        for a, b in links:
            if a == here and b not in found:
                found[b] = found[here] + 1
                todo.append(b)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_closure_has_all_pairs_with_least_steps(spark, seed):
    rng = random.Random(seed)
    links = {(k, i, i + 1) for k in "ab" for i in range(1, 40) if rng.random() < 0.8}
    links |= {(k, rng.randint(1, 40), rng.randint(1, 60)) for k in "ab" for _ in range(12)} | {("c", 5, 5), ("d", 7, 8)}
    want = set()
    for k in "abcd":
        own = [(a, b) for i, a, b in links if i == k]
        for start in {x for pair in own for x in pair}:
            want |= {(k, start, b, d) for b, d in _distances(own, start).items()}
    df = spark.createDataFrame(sorted(links), "issue_id string, a long, b long")
    assert sorted(tuple(r) for r in closure(df.union(df)).select("issue_id", "a", "b", "d").collect()) == sorted(want)


def test_closure_takes_few_rounds_along_a_chain(spark, monkeypatch):
    from quire.plans import closure as module

    rounds = []
    monkeypatch.setattr(module, "materialize", lambda df, name: rounds.append(name) or materialize(df, name))
    df = spark.range(150).select(F.lit("i").alias("issue_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert closure(df).count() == 151 * 152 // 2
    assert len(rounds) <= 9
    assert closure(df.limit(0)).count() == 0
