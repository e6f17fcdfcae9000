"""Approximate nearest neighbours by largest inner product: a vantage-point tree per shard.

A vector gets one more component, the root of the largest squared length in the shard minus its own, and a query is scaled to
that largest length. Then the order of distances is the order of inner products, and distances obey the triangle inequality.
A node keeps the range of distances from its vantage point to each of its two halves. A half is left out if the smallest
distance it can hold is at least ``factor`` times the query's current k-th distance: factor 1 restores exact search, a smaller
one leaves out more. The k-th score of a first shard is known to all others; it leaves out cells and halves exactly. Whole blocks of
queries go down together, each query into its nearer half first.

Defined results: see ``vectors``; zero vectors take no part; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from quire.llm import vectors
from quire.llm.vectors import Best

LEAF = 512


def build(points: np.ndarray) -> dict:
    """Tree over all points: nodes as arrays, points (and their numbers, ``ids``) in the order of the leaves."""
    lengths = np.einsum("ij,ij->i", points, points)
    top = float(lengths.max())
    lifted = np.concatenate([points, np.sqrt(np.maximum(top - lengths, 0))[:, None]], axis=1)
    order = np.arange(len(points))
    rng = np.random.default_rng(len(points))
    nodes: list[list[float]] = []  # first, last, inner child, outer child, ranges of inner and outer distances
    vantage: list[np.ndarray] = []
    todo = [(0, len(points), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        nodes.append([lo, hi, -1, -1, 0, 0, 0, 0])
        vantage.append(lifted[0])
        if hi - lo <= LEAF:
            continue
        own = order[lo:hi]
        far = lifted[own[rng.integers(hi - lo)]]
        point = lifted[own[np.argmax(((lifted[own] - far) ** 2).sum(axis=1))]]  # a point at the edge separates best
        d = np.sqrt(((lifted[own] - point) ** 2).sum(axis=1))
        rank = np.argsort(d, kind="stable")
        half = (hi - lo) // 2
        order[lo:hi] = own[rank]
        d = d[rank]
        vantage[me] = point
        nodes[me][4:] = [d[0], d[half - 1], d[half], d[-1]]
        todo += [(lo, lo + half, me, 0), (lo + half, hi, me, 1)]
    return {
        "ids": order, "points": points[order], "top": top, "nodes": np.array(nodes), "vantage": np.array(vantage)
    }


def lifted_distance(product: np.ndarray, size: np.ndarray, top: float) -> np.ndarray:
    """Distance between a query scaled to ``top`` and a lifted point, from their inner product before scaling."""
    return np.sqrt(np.maximum(2 * top * top - 2 * top / size * product, 0))


def allowed(most: np.ndarray, size: np.ndarray, bounds: np.ndarray, top: float) -> np.ndarray:
    """Cells that may hold something better than the bound."""
    return most >= bounds[:, None] - 1e-9 * (np.where(bounds > -np.inf, np.abs(bounds), 0) + size * top)[:, None]


def visit_with(factor: float, leaves: list | None = None):  # type: ignore[no-untyped-def]
    """Visit of a tree; ``leaves`` collects (looked at, all) per query and leaf, where the share of visits is measured."""

    def visit(tree: dict, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple:
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        top = np.sqrt(tree["top"])
        # a bound from another shard may be off by the rounding of a sum
        best = Best(len(queries), k, bounds - 1e-9 * (np.where(bounds > -np.inf, np.abs(bounds), 0) + size * top))
        nodes, vantage = tree["nodes"], tree["vantage"]

        def reach(who: np.ndarray) -> np.ndarray:
            # relaxed for what this tree has found itself, exact for what other shards are known to hold
            least = np.inf
            for kth, share in ((best.score[who, -1], factor), (best.floor[who], 1.0)):
                known = np.where(kth > -np.inf, kth, 0)
                least = np.minimum(least, np.where(kth > -np.inf, share * lifted_distance(known, size[who], top), np.inf))
            return least + 1e-9 * top

        def go(at: int, who: np.ndarray) -> None:
            if not len(who):
                return
            lo, hi, inner, outer = (int(x) for x in nodes[at, :4])
            if inner < 0:
                best.add(who, tree["ids"][lo:hi], queries[who] @ tree["points"][lo:hi].T)
                if leaves is not None:
                    leaves.append((len(who), len(queries) * int((nodes[:, 2] < 0).sum())))
                return
            d = lifted_distance(queries[who] @ vantage[at, :-1], size[who], top)
            least = [
                np.maximum(np.maximum(d - nodes[at, 5], nodes[at, 4] - d), 0),
                np.maximum(np.maximum(d - nodes[at, 7], nodes[at, 6] - d), 0),
            ]
            split = (nodes[at, 5] + nodes[at, 6]) / 2
            near = d <= split
            go(inner, who[near])
            go(outer, who[~near])
            again = near & (least[1] < reach(who))
            go(outer, who[again])
            again = ~near & (least[0] < reach(who))
            go(inner, who[again])

        go(0, np.arange(len(queries)))
        who, found, _ = best.rows()
        # the score itself in one fixed order of summation
        place = np.argsort(tree["ids"], kind="stable")
        return who, found, (queries[who] * tree["points"][place[found]]).sum(axis=1)

    return visit


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each query, without the query itself."""
    rows = vectors.valid(embeddings, vector, zero=False)
    return vectors.search(rows, is_query, k, build, visit_with(factor), lambda points: points, allowed)
