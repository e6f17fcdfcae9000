"""Search of a stated query set against all vectors: cells in space, an index per shard of a cell, queries sent to the cells they need.

Pivots are found on at most ``SAMPLE`` vectors; every vector goes to the cell of its nearest pivot, and a cell with more than
``SHARD_ROWS`` vectors is dealt over several shards by a hash. Of each cell only its pivot, the largest distance to it and the number
of shards are kept (``CELLS`` rows at most, whatever the input). A query first asks one shard of its best cell for ``k`` answers; the
k-th of them bounds all others, so it is then sent only to cells whose ball may hold something better. One task holds one shard's
index and streams the queries sent to it: indexes are shuffled once, a query once per shard it needs.

Vectors that are null, empty or hold null or non-finite components take no part; rows that repeat a vec_id count as one, with the
smallest of their vectors; null ids take no part; only vectors of equal length meet; equal vectors of a shard are one point with a
list of ids, so ties go to the smaller vec_id however many there are; vectors of any length are held whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import textops
from quire.session import materialize

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
CELLS = 1024
SAMPLE = 16_384
ROUNDS = 5


def valid(embeddings: DataFrame, vector: str, zero: bool) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & sound)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def pivots_of(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Cell centres of a sample: a few rounds of means, started at evenly spread rows."""
    centers = np.unique(sample, axis=0)
    centers = centers[np.linspace(0, len(centers) - 1, min(wanted, len(centers))).astype(int)]
    for _ in range(ROUNDS):
        near = nearest_pivot(sample, centers)[0]
        counts = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def nearest_pivot(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a near pivot of each point, and the true distance to it."""
    near = np.argmax(points @ pivots.T - 0.5 * np.einsum("ij,ij->i", pivots, pivots), axis=1)
    return near, np.sqrt(((points - pivots[near]) ** 2).sum(axis=1))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length among the vectors of a list column."""
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(at)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, values[at[rows][:, None] + np.arange(dim)]


class Cells:
    """Pivots by vector length; a length without any is one cell around zero."""

    def __init__(self, sample: list[list[float]], wanted: int, space: Callable[[np.ndarray], np.ndarray]) -> None:
        self.space = space
        self.pivots: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        free = 0
        for dim in sorted({len(v) for v in sample}):
            own = np.array([v for v in sample if len(v) == dim], dtype=np.float64)
            self.pivots[dim] = pivots_of(space(own), max(1, wanted * len(own) // len(sample)))
            self.first[dim] = free
            free += len(self.pivots[dim])

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the cell and distance to its centre of each point (of one length)."""
        dim = points.shape[1]
        if dim not in self.pivots:
            return np.full(len(points), -dim), np.sqrt((points**2).sum(axis=1))
        near, distance = nearest_pivot(points, self.pivots[dim])
        return self.first[dim] + near, distance

    def of_length(self, dim: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the ``known`` cells that hold vectors of a length, and their centres."""
        if dim not in self.pivots:
            return known[known == -dim], np.zeros((int((known == -dim).sum()), dim))
        first = self.first[dim]
        own = known[(known >= first) & (known < first + len(self.pivots[dim]))]
        return own, self.pivots[dim][own - first]


def _joined_points(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct points along their smallest ids; the ids of each in ascending order, one after another; their offsets."""
    order = np.lexsort((ids, *points.T))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (points[order][1:] != points[order][:-1]).any(axis=1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(ids)))
    by_id = np.argsort(ids[order][first], kind="stable")
    members = ids[order][textops.ranges(first[by_id], count[by_id])]
    return points[order][first][by_id], members, np.concatenate([[0], np.cumsum(count[by_id])])


def _indexes(rows: DataFrame, index: Callable[[np.ndarray], Any], space: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One row per shard and vector length: shard, body (the pickled index)."""

    def close(at: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
        for dim in sorted({p.shape[1] for _, p in held}):
            ids = np.concatenate([i for i, p in held if p.shape[1] == dim])
            points, members, first = _joined_points(ids, np.concatenate([p for _, p in held if p.shape[1] == dim]))
            yield {"shard": at, "body": pickle.dumps((index(space(points)), members, first), protocol=5)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            shard, ids = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and shard[lo] != at:
                    for row in close(at, held):
                        yield pa.RecordBatch.from_pylist([row])
                    held = []
                at = int(shard[lo])
                held += [(ids[lo:hi][r], m) for r, m in matrices(batch.column(2).slice(lo, hi - lo))]
        for row in close(at, held) if held else ():
            yield pa.RecordBatch.from_pylist([row])

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "vec_id").select("shard", "vec_id", "v")
    return dealt.mapInArrow(textops.tidy(run), "shard long, body binary")


def _first_k(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the best ``k`` of each query."""
    order = np.lexsort((ids, -score, who))
    begins = np.searchsorted(who[order], who[order], side="left")
    return order[np.arange(len(order)) - begins < k]


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    index: Callable[[np.ndarray], Any],
    visit: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]],
    space: Callable[[np.ndarray], np.ndarray],
    allowed: Callable[..., np.ndarray],
    kind: str = "double",
) -> DataFrame:
    """query_id, rank, vec_id, score (of SQL type ``kind``) of the best ``k`` found.

    ``space(vectors)`` are the points that are searched; ``index(points)`` builds a shard's index; ``visit(index, points, bounds, k)``
    answers queries with rows (query, point, score); ``allowed(most, sizes, bounds, top)`` says which (query, cell) may hold a better
    answer, given the largest inner product the ball of the cell allows, the lengths of the queries and of the longest vector.
    """
    rows = materialize(rows, "vectors")
    n = rows.count()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()]
    cells = Cells(sample, min(CELLS, -(-n // SHARD_ROWS)), space)

    def placed(column: pa.Array) -> pa.Array:
        cell, distance, size = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
        for at, points in matrices(column):
            points = space(points)
            cell[at], distance[at] = cells.place(points)
            size[at] = np.sqrt((points**2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(x) for x in (cell, distance, size)], names=["cell", "distance", "size"])

    place = F.arrow_udf(placed, "cell long, distance double, size double").asNondeterministic()
    rows = materialize(rows.select("vec_id", "v", place("v").alias("p")).select("vec_id", "v", "p.*"), "cells")
    known = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max("size").alias("top")).collect()
    number = np.array(sorted(r["cell"] for r in known), dtype=np.int64)
    by_cell = {r["cell"]: r for r in known}
    radius = np.array([by_cell[c]["radius"] for c in number.tolist()])
    parts = np.array([-(-by_cell[c]["n"] // SHARD_ROWS) for c in number.tolist()], dtype=np.int64)
    begin = np.cumsum(parts) - parts  # first shard of each cell
    top = max((r["top"] for r in known), default=0.0)
    # each cell's first shard and number of shards, in the plan as two short arrays
    listed = [F.from_json(F.lit(str(x.tolist())), "array<long>") for x in (number, begin, parts)]
    spot = F.array_position(listed[0], F.col("cell")).cast("int") - 1
    shard = F.get(listed[1], spot) + F.pmod(F.xxhash64("vec_id"), F.get(listed[2], spot))
    trees = materialize(_indexes(rows.withColumn("shard", shard), index, space), "trees")
    questions = rows.where(is_query).select("vec_id", "v")

    def routed(first: bool):  # type: ignore[no-untyped-def]
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(lo, BLOCK_ROWS)
                    ids, bounds = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    for at, vectors in matrices(part.column(1)):
                        own, centers = cells.of_length(vectors.shape[1], number)
                        points = space(vectors)
                        if not len(own):
                            continue
                        spots, size = np.searchsorted(number, own), np.sqrt((points**2).sum(axis=1))
                        most = points @ centers.T + size[:, None] * radius[spots]
                        most += 1e-9 * (np.abs(most) + size[:, None] * (np.sqrt((centers**2).sum(axis=1)) + radius[spots]) + 1)
                        if first:
                            go = np.arange(len(own)) == np.argmax(points @ centers.T, axis=1)[:, None]
                        else:
                            go = allowed(most, size, np.where(np.isnan(bounds[at]), -np.inf, bounds[at]), top)
                        for j in np.flatnonzero(go.any(axis=0)):
                            mine = np.flatnonzero(go[:, j])
                            body = pickle.dumps((ids[at[mine]], vectors[mine], bounds[at[mine]]), protocol=5)
                            spot = spots[j]
                            targets = [begin[spot]] if first else range(begin[spot], begin[spot] + parts[spot])
                            yield pa.RecordBatch.from_pylist([{"shard": int(s), "body": body} for s in targets])

        return run

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for s, asks, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != at:
                    at, held = s, []
                if not asks:
                    held.append(pickle.loads(body))
                    continue
                ids, vectors, bounds = pickle.loads(body)
                points = space(vectors)
                for tree, members, first in held:
                    if tree["points"].shape[1] != points.shape[1]:
                        continue
                    # the query's own point takes one of the places
                    who, point, score = visit(tree, points, np.where(np.isnan(bounds), -np.inf, bounds), k + 1)
                    count = np.minimum(first[point + 1] - first[point], k + 1)
                    who, score = np.repeat(who, count), np.repeat(score, count)
                    found = members[textops.ranges(first[point], count)]
                    keep = np.flatnonzero(found != ids[who])
                    keep = keep[_first_k(who[keep], found[keep], score[keep], k)]
                    scores = pa.array(score[keep].astype(np.int64 if kind == "long" else np.float64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[who[keep]]), pa.array(found[keep]), scores], names=["query_id", "vec_id", "score"]
                    )

    def answers(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(textops.tidy(routed(first)), "shard long, body binary").withColumn("asks", F.lit(True))
        both = trees.withColumn("asks", F.lit(False)).unionByName(sent).select("shard", "asks", "body")
        dealt = both.repartition("shard").sortWithinPartitions("shard", "asks")
        return dealt.mapInArrow(textops.tidy(answered), f"query_id long, vec_id long, score {kind}")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    no_bound = questions.withColumn("bound", F.lit(None).cast("double"))
    quick = materialize(best(answers(no_bound, True)), "answers")
    bounds = quick.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    bounded = materialize(questions.join(bounds, "vec_id", "left"), "bounds")
    # with a factor below one even the first cell may be left out the second time
    every = quick.drop("rank").unionByName(answers(bounded, False)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(every).select("query_id", "rank", "vec_id", "score")


class Best:
    """The best ``k`` points per query so far: larger scores first, ties to the smaller number."""

    def __init__(self, queries: int, k: int, bounds: np.ndarray) -> None:
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = bounds
        self.k = k

    def kth(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[who, -1], self.floor[who])

    def add(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """``score`` has a row per query of ``who`` and a column per id."""
        useful = np.flatnonzero((score >= self.kth(who)[:, None]).any(axis=1))
        if not len(useful):
            return
        who, score = who[useful], score[useful]
        if score.shape[1] > 2 * self.k:
            # all that could be among the best, ties at the edge included
            edge = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
            width = int((score >= edge[:, None]).sum(axis=1).max())
            pick = np.argpartition(-score, min(width, score.shape[1]) - 1, axis=1)[:, :width]
            score, listed = np.take_along_axis(score, pick, axis=1), ids[pick]
        else:
            listed = np.broadcast_to(ids, score.shape)
        s = np.concatenate([self.score[who], score], axis=1)
        i = np.concatenate([self.ids[who], listed], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[who], self.ids[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, col = np.nonzero(self.score > -np.inf)
        return who, self.ids[who, col], self.score[who, col]
