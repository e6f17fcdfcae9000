"""Exact top-k by inner product of whole-number vectors: a ball tree per shard, branch and bound.

Components are floor(1024 * x). A ball's inner product with a query is at most query * center + |query| * radius. Nodes are gone
through in the order of that bound, and a node whose bound lies below the query's k-th score is left out. The k-th score is shared:
a first visit asks one shard of the query's best cell, and the k-th of its answers bounds the search of all shards; cells whose
bound lies below it are not visited.

All sums are exact while length * max(component)^2 < 2^53 (for 64 components: |x| < 11,000); beyond it a shard is scored
with Python's whole numbers instead of doubles, and without pruning. Scores beyond 64 bits are cut to the range of long.

Defined results: see ``vectors``; zero vectors take part; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from quire.llm import vectors
from quire.llm.vectors import Best

LEAF = 512
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def space(vectors_: np.ndarray) -> np.ndarray:
    return np.floor(1024.0 * vectors_)


def build(points: np.ndarray) -> dict:
    order = np.arange(len(points))
    nodes: list[list[float]] = []
    centers, todo = [], [(0, len(points), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        own = points[order[lo:hi]]
        center = own.mean(axis=0)
        nodes.append([lo, hi, -1, -1, np.sqrt(((own - center) ** 2).sum(axis=1)).max()])
        centers.append(center)
        if hi - lo <= LEAF or nodes[me][4] == 0:
            continue
        # along the line between two points that lie far apart
        a = own[np.argmax(((own - center) ** 2).sum(axis=1))]
        b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
        order[lo:hi] = order[lo:hi][np.argsort(own @ (b - a), kind="stable")]
        half = (lo + hi) // 2
        todo += [(lo, half, me, 0), (half, hi, me, 1)]
    return {"ids": order, "points": points[order], "nodes": np.array(nodes), "centers": np.array(centers)}


def _exact(queries: np.ndarray, points: np.ndarray) -> bool:
    return points.shape[1] * max(1.0, np.abs(points).max()) * max(1.0, np.abs(queries).max()) < EXACT


def _whole(tree: dict, queries: np.ndarray, k: int) -> tuple:
    """All scores of a shard in whole numbers of any size."""
    who, found, score = [], [], []
    points = [[int(x) for x in p] for p in tree["points"]]
    for q, row in enumerate(queries):
        own = [int(x) for x in row]
        rank = sorted((-sum(map(int.__mul__, own, p)), i) for p, i in zip(points, tree["ids"].tolist(), strict=True))
        for s, i in rank[:k]:
            who.append(q)
            found.append(i)
            score.append(max(-LONG - 1, min(LONG, -s)))
    return np.array(who, dtype=np.int64), np.array(found, dtype=np.int64), np.array(score, dtype=np.int64)


def allowed(most: np.ndarray, size: np.ndarray, bounds: np.ndarray, top: float) -> np.ndarray:
    return most >= bounds[:, None]


def visit(tree: dict, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple:
    if not _exact(queries, tree["points"]):
        return _whole(tree, queries, k)
    best = Best(len(queries), k, bounds)
    nodes, size = tree["nodes"], np.sqrt((queries**2).sum(axis=1))
    middle = queries @ tree["centers"].T
    most = middle + size[:, None] * nodes[:, 4]
    most += 1e-9 * (np.abs(most) + size[:, None] * np.sqrt((tree["centers"] ** 2).sum(axis=1)) + 1)

    def go(at: int, who: np.ndarray) -> None:
        who = who[most[who, at] >= best.kth(who)]
        if not len(who):
            return
        lo, hi, left, right = (int(x) for x in nodes[at, :4])
        if left < 0:
            best.add(who, tree["ids"][lo:hi], queries[who] @ tree["points"][lo:hi].T)
            return
        ahead = most[who, left] >= most[who, right]
        go(left, who[ahead])
        go(right, who[~ahead])
        go(right, who[ahead])
        go(left, who[~ahead])

    go(0, np.arange(len(queries)))
    return best.rows()


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): the ``k`` highest inner products of each query, without the query itself."""
    return vectors.search(vectors.valid(embeddings, vector, zero=True), is_query, k, build, visit, space, allowed, kind="long")
