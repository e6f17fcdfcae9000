"""Fill-in-middle transformation by displacement scatter.

A text is cut twice between tokens (white space and the word after it) and put together again around markers. Per batch, one scan
finds the ends of all tokens; a difference array holds, at the first byte of each part, how much farther than the part before it has
to move; its running sum is the shift of every byte, and one scatter builds all outputs. The inverse finds the markers in the
outputs, builds the same kind of array in the other direction, and gathers the text.

The marker strings stand nowhere in a text that is transformed (such a text stays plain), so they are found again without stored cuts.

Defined results: a null text counts as empty, and an empty text stays plain; a null doc_id is drawn as the empty string; rows that
repeat a doc_id are cut each, at the same draws; very long texts are a chunk of their own, so memory follows the longest text; an
empty table gives an empty result; further columns travel in ``row``, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textops

MARKS = (b"<P>", b"<S>", b"<M>")
WIDE = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], dtype=object)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the SHA-256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def token_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of each token (byte position in the batch) and the offsets of the texts in that list.

    A token is a word with the white space before it, or white space up to the end of the text.
    """
    _, ends, first = textops.words(data, at)
    counts = np.diff(first)
    filled = np.diff(at) > 0
    last = np.full(len(counts), -1, dtype=np.int64)
    last[counts > 0] = ends[first[1:][counts > 0] - 1]
    tail = filled & (last != at[1:])
    return np.insert(ends, first[1:][tail], at[1:][tail]), np.concatenate([[0], np.cumsum(counts + tail)])


def marked(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold one of the markers."""
    found = np.zeros(len(data), dtype=bool)
    if len(data) >= WIDE:
        inner = (data[1:-1] == 80) | (data[1:-1] == 83) | (data[1:-1] == 77)
        found[:-2] = (data[:-2] == 60) & inner & (data[2:] == 62)
    place = np.flatnonzero(found)
    owner = np.searchsorted(at, place, side="right") - 1
    out = np.zeros(len(at) - 1, dtype=bool)
    out[owner[place + WIDE <= at[owner + 1]]] = True
    return out


def shifts(starts: list[np.ndarray], moves: list[np.ndarray], length: int) -> np.ndarray:
    """Running sum of the differences between the moves of consecutive parts (part by part of each text, texts in order)."""
    begin = np.stack(starts, axis=1).ravel()
    move = np.stack(moves, axis=1).ravel()
    jump = np.diff(move, prepend=0)
    edge = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edge, begin, jump)
    return np.cumsum(edge[:length])


def scatter(data: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all texts and their offsets; ``a`` and ``b`` are the two cuts as positions in the batch."""
    lo, hi = at[:-1], at[1:]
    cut = form != PLAIN
    out_at = np.concatenate([[0], np.cumsum(hi - lo + 3 * WIDE * cut)])
    base = out_at[:-1]
    n1, n2, n3 = a - lo, b - a, hi - b
    spm = form == SPM
    to1 = base + np.where(cut, WIDE + np.where(spm, n3 + WIDE, 0), 0)
    to3 = base + np.where(cut, WIDE + np.where(spm, 0, n1 + WIDE), n1 + n2)
    to2 = base + np.where(cut, n1 + n3 + 3 * WIDE, n1)
    out = np.zeros(int(out_at[-1]), dtype=np.uint8)
    out[np.arange(len(data)) + shifts([lo, a, b], [to1 - lo, to2 - a, to3 - b], len(data))] = data
    for mark, place in zip(MARKS, (to1, to3, to2), strict=True):
        begin = place[cut] - WIDE
        out[begin[:, None] + np.arange(WIDE)] = np.frombuffer(mark, dtype=np.uint8)
    return out, out_at


def gather(out: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from outputs and forms: the inverse of ``scatter`` without its cuts."""
    lo, hi = at[:-1], at[1:]
    cut = form != PLAIN
    row = np.flatnonzero(cut)
    head = np.zeros(len(out), dtype=bool)
    if len(out) >= WIDE:
        head[:-2] = (out[:-2] == 60) & (out[2:] == 62)
    place = []
    for mark in MARKS:
        hits = head.copy()
        hits[:-1] &= out[1:] == mark[1]
        spots = np.flatnonzero(hits)
        # the marker of each text that was cut: the first one in it
        place.append(spots[np.searchsorted(spots, lo[row])] if len(row) else row)
    p, s, m = (x + WIDE for x in place)
    spm = form[row] == SPM
    n1 = np.where(spm, m, s) - WIDE - p
    n3 = np.where(spm, p, m) - WIDE - s
    n2 = hi[row] - m
    size = hi - lo - 3 * WIDE * cut
    text_at = np.concatenate([[0], np.cumsum(size)])
    begin = text_at[:-1]
    b1, b2, b3 = begin.copy(), begin + size, begin + size
    m1, m2, m3 = lo - begin, lo - begin, lo - begin
    b2[row] = begin[row] + n1
    b3[row] = b2[row] + n2
    m1[row], m2[row], m3[row] = p - b1[row], m - b2[row], s - b3[row]
    total = int(text_at[-1])
    return out[np.arange(total) + shifts([b1, b2, b3], [m1, m2, m3], total)], text_at


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def transform(documents: DataFrame, seed: int = 42, cut: int = 50, spm: int = 80, text: str = "text") -> DataFrame:
    """row (all columns without the text), n, form, prefix_chars, middle_chars, output for each row.

    ``cut`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first. Cuts are drawn from seed and doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in textops.chunks(batches, "text"):
            h1, h2, h3, h4 = (rows.column(i).to_numpy() for i in range(1, 5))
            ends, first = token_ends(data, at)
            n = np.diff(first)
            form = np.where(h4 % 100 < spm, SPM, PSM)
            form[(n == 0) | (h3 % 100 >= cut) | marked(data, at)] = PLAIN
            units = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            ends = np.append(ends, 0)
            a, b = (np.where(u > 0, ends[first[:-1] + u - 1], at[:-1]) for u in units)
            out, out_at = scatter(data, at, a, b, form)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            plain = pa.array(form == PLAIN)
            chars = [pa.array(points[y] - points[x]) for x, y in ((at[:-1], a), (a, b))]
            none = pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(n),
                    pa.array(FORMS[form], pa.string()),
                    *[pc.if_else(plain, none, c) for c in chars],
                    _strings(out, out_at),
                ],
                names=["row", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    row, kind = textops.without(documents, text)
    given = documents.select(row.alias("row"), *draws(F.col("doc_id"), seed), F.col(text).alias("text"))
    return given.mapInArrow(textops.tidy(run), f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame) -> DataFrame:
    """All columns of ``transformed`` and ``restored``: the text, from ``output`` and ``form`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {name: i for i, name in enumerate(FORMS)}
        for rows, data, at in textops.chunks(batches, "output"):
            form = np.array([codes[x] for x in rows.column(1).to_pylist()], dtype=np.int64)
            text, text_at = gather(data, at, form)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), _strings(text, text_at)], names=["row", "output", "restored"]
            )

    kept = [c for c in transformed.columns if c != "output"]
    row = F.struct(*kept)
    kind = transformed.select(row.alias("row")).schema["row"].dataType.simpleString()
    back = transformed.select(row.alias("row"), "form", "output").mapInArrow(textops.tidy(run), f"row {kind}, output string, restored string")
    return back.select(*[F.col("row")[c].alias(c) for c in kept], "output", "restored")
