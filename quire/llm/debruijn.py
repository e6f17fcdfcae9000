"""Substring dedup over words by De Bruijn compaction.

The graph's edges are the windows of ``width`` words, its nodes the windows of one word less. It is never listed edge by edge:

1. Edges of a document that follow one another and share their minimizer (the smallest sub-window of ``ANCHOR`` words, by hash)
   form a path piece, one row with coordinates and two hashes. Equal edges have equal minimizers, so all pieces that may share an
   edge meet under one key. Equal pieces need no look at their edges: the first one (smallest doc_id) is the source of the others.
   Copies are found per chunk before the shuffle and per key after it.
2. Only pieces that share a minimizer with a different piece are opened into edges, which are matched the same way.
3. Pieces and edges that continue each other both in their document and in its source, so that the graph doesn't branch between
   them, are compacted into long paths along the document (a window per document, source and distance).
4. Both ends of a path are read again at their coordinates and compared by a digest of the words; only paths that agree count.
   A repeat inside one document points at its first occurrence there and shares that one's fate.

Defined results: a null or empty text has no words; documents below ``width`` words lose nothing; a row with a null doc_id takes
no part and stays whole; rows that repeat a doc_id count as one document, and what is found in one of them is removed from all;
an empty table gives an empty result; further columns are not read, so their names cannot clash. Memory follows the longest
text (about 100 bytes for each of its words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import textops
from quire.session import materialize

ANCHOR = 5
GATHER = 150_000
#: a piece: h, c, document, at = start << 16 | windows << 8 | place of the minimizer; a copy: c windows at ``at``, source (f, t)
_PIECE = "h long, c long, doc_id long, at long, f long, t long"
_RUN = "doc_id long, s long, n long, f long, t long"


def _rows(names: tuple[str, ...], **cols: np.ndarray) -> pa.RecordBatch:
    size = max(len(v) for v in cols.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[k], pa.int64()) if k in cols else pa.nulls(size, pa.int64()) for k in names], names=list(names)
    )


_P = ("h", "c", "doc_id", "at", "f", "t")
_R = ("doc_id", "s", "n", "f", "t")


def compacted(doc: np.ndarray, s: np.ndarray, n: np.ndarray, f: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
    """Runs united where one continues the other both in its document and in its source."""
    order = np.lexsort((s, s - t, f, doc))
    doc, s, n, f, t = doc[order], s[order], n[order], f[order], t[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1]) | (s[1:] != s[:-1] + n[:-1]) | (t[1:] != t[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return {"doc_id": doc[first], "s": s[first], "n": np.add.reduceat(n, first) if len(first) else n, "f": f[first], "t": t[first]}


def _reduced(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pieces of one chunk: the first of equal ones goes on, the others become copies of it."""
    order = np.lexsort((at, doc, c ^ (h * 3)))
    h, c, doc, at = h[order], c[order], doc[order], at[order]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & ((at[1:] ^ at[:-1]) & 0xFFFF == 0)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    yield _rows(_P, h=h[~same], c=c[~same], doc_id=doc[~same], at=at[~same])
    if same.any():
        own = np.flatnonzero(same)
        runs = compacted(doc[own], at[own] >> 16, at[own] >> 8 & 255, doc[head[own]], at[head[own]] >> 16)
        key = runs["doc_id"] * 0x5851F42D4C957F2D
        yield _rows(_P, h=key, c=runs["n"], doc_id=runs["doc_id"], at=runs["s"], f=runs["f"], t=runs["t"])


def _find(width: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for rows, data, at in textops.chunks(batches, "text"):
            starts, ends, first = textops.words(data, at)
            codes = tuple(textops.word_codes(data, starts, ends, i) for i in (0, 1))
            got = textops.pieces(codes, first, width, ANCHOR)
            ids = rows.column(rows.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((got["h"], got["c"], ids[got["text"]], got["start"] << 16 | got["n"] << 8 | got["off"]))
            count += len(got["h"])
            if count >= GATHER:
                yield from _reduced(*(np.concatenate([x[i] for x in held]) for i in range(4)))
                held, count = [], 0
        if count:
            yield from _reduced(*(np.concatenate([x[i] for x in held]) for i in range(4)))

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (h, c, doc_id, at): copies get their source; first pieces whose minimizer has several different ones go
    on without a source. One row passes from batch to batch: the last first piece, and whether it has gone on already.
    """
    kept: tuple[np.ndarray, ...] | None = None
    out = False
    for batch in batches:
        h, c, doc, at, f, t = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(6))
        copies = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        if copies.any():
            yield _rows(_R, doc_id=doc[copies], s=at[copies], n=c[copies], f=f[copies], t=t[copies])
            h, c, doc, at = (x[~copies] for x in (h, c, doc, at))
        lead = kept is not None
        if lead:
            h, c, doc, at = (np.concatenate([k, x]) for k, x in zip(kept, (h, c, doc, at), strict=True))
        if not len(h):
            continue
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | ((at[1:] ^ at[:-1]) & 0xFFFF != 0)
        firsts = np.flatnonzero(new)
        keys = h[firsts]
        shared = np.zeros(len(firsts), dtype=bool)
        shared[1:] = keys[1:] == keys[:-1]
        shared[:-1] |= keys[1:] == keys[:-1]
        if lead and out:
            shared |= keys == keys[0]
        give = shared.copy()
        if lead and out:
            give[0] = False
        if give.any():
            g = firsts[give]
            yield _rows(_R, doc_id=doc[g], s=at[g] >> 16, n=at[g] >> 8 & 255)
        later = np.flatnonzero(~new)
        if len(later):
            head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))[later]
            moved = (doc[later] != doc[head]) | (at[later] != at[head])
            later, head = later[moved], head[moved]
            yield _rows(_R, doc_id=doc[later], s=at[later] >> 16, n=at[later] >> 8 & 255, f=doc[head], t=at[head] >> 16)
        last = firsts[-1]
        kept, out = tuple(x[last : last + 1] for x in (h, c, doc, at)), bool(shared[-1])


def _match_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in the order of (e1, e2, doc_id, at): every later one becomes a copy of the first."""
    kept: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if kept is not None:
            cols = tuple(np.concatenate([k, x]) for k, x in zip(kept, cols, strict=True))
        e1, e2, doc, at = cols
        if not len(e1):
            continue
        new = np.ones(len(e1), dtype=bool)
        new[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(e1)), 0))
        later = np.flatnonzero((doc != doc[head]) | (at != at[head]))
        head = head[later]
        if len(later):
            yield _rows(_R, **compacted(doc[later], at[later], np.ones(len(later), np.int64), doc[head], at[head]))
        last = np.flatnonzero(new)[-1]
        kept = tuple(x[last : last + 1] for x in cols)


def _open(width: int):  # type: ignore[no-untyped-def]
    """Per document with pieces to open: its edges there (e1, e2, doc_id, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                data, at = textops.joined(textops.unpack(rows.column(1)))
                wanted = rows.column(2)
                offsets = wanted.offsets.to_numpy().astype(np.int64)
                inner = slice(offsets[0], offsets[-1])
                s = wanted.values.field(0).to_numpy(zero_copy_only=False)[inner]
                n = wanted.values.field(1).to_numpy(zero_copy_only=False)[inner]
                owner = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
                starts, ends, first = textops.words(data, at)
                where = textops.ranges(first[owner] + s, n)
                docs = rows.column(0).to_numpy(zero_copy_only=False)[np.repeat(owner, n)]
                # a row that repeats a doc_id with another, shorter text has no such words
                ok = where + width <= first[1:][np.repeat(owner, n)]
                where, docs, local = where[ok], docs[ok], textops.ranges(s, n)[ok]
                e = [
                    textops.Rolling(textops.word_codes(data, starts, ends, i), i).slices(where, where + width).view(np.int64)
                    for i in (0, 1)
                ]
                yield _rows(("e1", "e2", "doc_id", "at"), e1=e[0], e2=e[1], doc_id=docs, at=local)

    return run


def _digest(width: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, s, n, digest = [], [], [], []
            texts, wanted = batch.column(1), batch.column(2).to_pylist()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                words = textops.unpack(texts.slice(i, 1))[0].split()
                for want in wanted[i]:
                    docs.append(doc)
                    s.append(want["s"])
                    n.append(want["n"])
                    digest.append(hashlib.sha256(b" ".join(words[want["s"] : want["s"] + want["n"] + width - 1])).digest()[:16])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary())],
                names=["doc_id", "s", "n", "digest"],
            )

    return run


def _cut(width: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            runs = batch.column(3)
            offsets = runs.offsets.to_numpy()
            s, n, t = (runs.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            packed = batch.column(2)
            for i in range(batch.num_rows):
                words = textops.unpack(packed.slice(i, 1))[0].split()
                lo, hi = offsets[i], offsets[i + 1]
                gone = np.zeros(len(words), dtype=bool)
                if hi > lo and len(words) >= width:
                    most = len(words) - width + 1
                    begin, end, own = np.minimum(s[lo:hi], most), np.minimum(s[lo:hi] + n[lo:hi], most), t[lo:hi]
                    away = own < 0
                    hit = textops.covered(begin[away], end[away], most)
                    seen = hit.copy()
                    for a, b, c in zip(begin[~away].tolist(), end[~away].tolist(), own[~away].tolist(), strict=True):
                        hit[a:b] |= seen[c : c + b - a]
                    windows = np.flatnonzero(hit)
                    gone = textops.covered(windows, windows + width, len(words))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words))
                total.append(len(words))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                names=["row", "kept", "n_words", "n_removed"],
            )

    return run


def repeated_paths(documents: DataFrame, width: int = 13, text: str = "text") -> DataFrame:
    """doc_id, s, n, f, t: the n windows from word s of a document also start from word t of document f, a smaller one or itself."""
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    packed = docs.mapInArrow(textops.tidy(textops.pack), "doc_id long, packed binary")
    found = docs.mapInArrow(textops.tidy(_find(width)), _PIECE).repartition("h").sortWithinPartitions("h", "c", "doc_id", "at")
    matched = materialize(found.mapInArrow(textops.tidy(_match), _RUN), "path-pieces")
    wanted = matched.where("f is null").groupBy("doc_id").agg(F.collect_set(F.struct("s", "n")).alias("r"))
    edges = packed.join(wanted, "doc_id").mapInArrow(textops.tidy(_open(width)), "e1 long, e2 long, doc_id long, at long")
    single = edges.repartition("e1").sortWithinPartitions("e1", "e2", "doc_id", "at").mapInArrow(textops.tidy(_match_edges), _RUN)
    runs = matched.where("f is not null").union(single)
    along = Window.partitionBy("doc_id", "f", "d").orderBy("s", "n")
    opens = F.coalesce((F.col("s") > F.lag(F.col("s") + F.col("n")).over(along)).cast("int"), F.lit(1))
    paths = (
        runs.withColumn("d", F.col("s") - F.col("t"))
        .withColumn("i", opens)
        .withColumn("i", F.sum("i").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("doc_id", "f", "d", "i")
        .agg(F.min("s").alias("s"), (F.max(F.col("s") + F.col("n")) - F.min("s")).alias("n"), F.min("t").alias("t"))
        .select("doc_id", "s", "n", "f", "t")
    )
    paths = materialize(paths, "paths")
    ends = paths.select("doc_id", "s", "n").union(paths.select("f", "t", "n"))
    asked = ends.groupBy("doc_id").agg(F.collect_set(F.struct("s", "n")).alias("r"))
    digests = materialize(
        packed.join(asked, "doc_id").mapInArrow(textops.tidy(_digest(width)), "doc_id long, s long, n long, digest binary"), "digests"
    )
    there = digests.select(F.col("doc_id").alias("f"), F.col("s").alias("t"), "n", F.col("digest").alias("source"))
    return (
        paths.join(digests, ["doc_id", "s", "n"])
        .join(there, ["f", "t", "n"])
        .where(F.col("digest") == F.col("source"))
        .select("doc_id", "s", "n", "f", "t")
    )


def remove_repeats(documents: DataFrame, width: int = 13, text: str = "text") -> DataFrame:
    """row (struct of all columns, the text being null), kept (binary: remaining words joined by one space), n_words, n_removed."""
    paths = repeated_paths(documents, width, text)
    own = F.when(F.col("f") == F.col("doc_id"), F.col("t")).otherwise(F.lit(-1)).alias("t")
    runs = paths.groupBy("doc_id").agg(F.collect_set(F.struct("s", "n", own)).alias("r"))
    slim, kind = textops.without(documents, text)
    rows = documents.select(slim.alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.col(text).alias("text"))
    rows = rows.mapInArrow(textops.tidy(textops.pack), f"row {kind}, _doc long, packed binary")
    none = F.array().cast("array<struct<s:bigint,n:bigint,t:bigint>>")
    joined = rows.join(runs, F.col("_doc") == F.col("doc_id"), "left")
    return joined.select("row", "_doc", "packed", F.coalesce("r", none).alias("r")).mapInArrow(
        textops.tidy(_cut(width)), f"row {kind}, kept binary, n_words long, n_removed long"
    )
