"""Tree searches against brute force: exactness, recall, odd vectors, ties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import balltree, vectors, vptree

SCHEMA = "vec_id long, embedding array<float>, label int, v int, key int"


@pytest.fixture
def small(monkeypatch):
    """Several shards, blocks and tree levels on a small table."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 150)
    monkeypatch.setattr(vectors, "CELLS", 5)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(balltree, "LEAF", 8)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def points(seed, n=400, dim=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(7, dim))
    x = (centers[rng.integers(7, size=n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    x[50:60] = x[49]  # ties
    rows = [(i, x[i].tolist()) for i in range(n)]
    return rows + [(1000, None), (1020, [0.0] * dim), (1040, [float("nan")] * dim), (1060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1080, [])]


def brute(rows, step, k, whole):
    ok = {i: np.array(v, dtype=float) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)}
    ok = {i: np.floor(1024 * v) for i, v in ok.items()} if whole else {i: v for i, v in ok.items() if v.any()}
    out = {}
    for q, a in ok.items():
        if q % step == 0:
            best = sorted((-(a * b).sum(), i) for i, b in ok.items() if i != q)[:k]
            out[q] = [(i, round(-s, 9)) for s, i in best]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    return out


def test_exact_at_factor_one(spark, small):
    rows = points(1)
    assert listed(vptree.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, 1.0)) == brute(rows, 20, 20, False)


def test_recall_at_the_factor_in_use(spark, small):
    rows = points(2)
    got, want = listed(vptree.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, 0.3)), brute(rows, 20, 20, False)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_ball_tree(spark, small):
    rows = points(3)
    assert listed(balltree.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, 10)) == brute(rows, 100, 10, True)


def test_few_candidates_huge_numbers_and_no_rows(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (20, [1e12, -1e12]), (None, [1.0, 1.0]), (7, [1e9, 3.0]), (0, [0.5, 0.0])])
    got = listed(balltree.top_k(few, F.col("vec_id") % 20 == 0, 10))
    big = int(np.floor(1024 * np.float64(np.float32(1e12))))
    assert got[0] == [(20, 512 * big), (7, 512 * 1024 * 10**9)]
    assert got[20] == [(7, (1 << 63) - 1), (0, 512 * big)]
    assert [len(x) for x in listed(vptree.nearest(few, F.col("vec_id") % 20 == 0)).values()] == [2, 2]
    none = frame(spark, [])
    assert vptree.nearest(none, F.col("vec_id") % 20 == 0).count() == balltree.top_k(none, F.col("vec_id") % 20 == 0).count() == 0


def test_many_equal_vectors_tie_to_the_smaller_id(spark, small):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).astype(np.float32).tolist()) for i in range(600)]
    assert listed(vptree.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, 1.0)) == brute(rows, 20, 20, False)
    assert listed(balltree.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, 10)) == brute(rows, 100, 10, True)


def test_queries_go_only_to_cells_that_may_hold_better(spark, small):
    """Tight clusters on a sphere: nearly all queries need their own cell only, and results stay exact."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(5, 12))
    x = centers[np.arange(500) % 5] / np.linalg.norm(centers[np.arange(500) % 5], axis=1)[:, None] + 0.01 * rng.normal(size=(500, 12))
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(500)]
    asked = []
    got = listed(balltree.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, 10))
    assert got == brute(rows, 100, 10, True)
    cells = vectors.Cells([v for _, v in rows], 5, balltree.space)
    points = balltree.space(np.array([v for _, v in rows], dtype=float))
    cell, distance = cells.place(points)
    radius = np.array([distance[cell == c].max(initial=0) for c in range(5)])
    for q in range(0, 500, 100):
        most = points[q] @ cells.pivots[12].T + np.linalg.norm(points[q]) * radius
        asked.append(int(balltree.allowed(most[None], np.ones(1), np.array([float(got[q][-1][1])]), 0.0).sum()))
    assert sum(asked) <= 2 * len(asked)
