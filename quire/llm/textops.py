"""Vectorised text primitives for Arrow batches: flat bytes, words, rolling hashes and minimizer pieces.

All work on one flat array for many texts. Batches are cut into chunks of bounded size (a single longer text is a chunk of its
own, so memory follows the longest text, never the partition).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 18
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
ROWS = 1024
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values (multiply and shift)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


CODES = (byte_codes(1), byte_codes(2))
#: odd bases of the rolling hashes and their inverses modulo 2**64
BASES = tuple(_U(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in BASES)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of a base or its inverse; kept for chunks of usual size."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = INVERSES[which] if inverse else BASES[which]
        have = np.full(max(n, 1), base, dtype=_U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK:
            _POWERS[which, inverse] = have
    return have[:n]


class Rolling:
    """Hash of any slice of a symbol array in constant time (polynomial modulo 2**64, finalised)."""

    def __init__(self, symbols: np.ndarray, which: int = 0) -> None:
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(symbols * powers(n, which), out=self.sums[1:])
        self.undo = powers(n + 1, which, inverse=True)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.undo[start])

    def windows(self, k: int) -> np.ndarray:
        """Hash of each window of ``k`` symbols, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.undo[:n]) if n > 0 else np.zeros(0, dtype=_U)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and offsets (one more than texts). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system; Python workers are reused by later tasks, and wait for them beside the JVM."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):  # type: ignore[no-untyped-def]
    """``run`` for ``mapInArrow``, with ``release`` at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple]:
    """(rows as a record batch, bytes, offsets) of at most ``limit`` bytes and ``ROWS`` rows, or of one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = flat(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            hi = min(hi, lo + ROWS, batch.num_rows)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the offsets of the texts in the list of words."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True  # a text begins here
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, at)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit code of each word."""
    return Rolling(CODES[which][data], which).slices(starts, ends)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each window of ``width`` values (compared by their upper 33 bits)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = _U((1 << 31) - 1)
    size = -(-len(values) // width) * width
    packed = np.full(size, np.iinfo(_U).max, dtype=_U)
    packed[: len(values)] = (values & ~low) | np.arange(len(values), dtype=_U)
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def pieces(symbols: tuple[np.ndarray, np.ndarray], at: np.ndarray, width: int, anchor: int) -> dict[str, np.ndarray]:
    """Cut the windows of ``width`` symbols of each text into runs that share their anchor.

    The anchor of a window is its smallest sub-window of ``anchor`` symbols (by hash, leftmost first), so equal windows have equal
    anchors wherever they stand. A run of ``n`` windows from ``start`` covers n + width - 1 symbols. Returned per run: text, start
    (from the beginning of the text), n, off (anchor minus start), h (hash of the anchor) and c (an independent hash of all symbols
    of the run).
    """
    lengths = np.diff(at)
    total = len(symbols[0])
    none = {k: np.zeros(0, dtype=np.int64) for k in ("text", "start", "n", "off", "h", "c")}
    if total < width:
        return none
    subs = Rolling(symbols[0], 0).windows(anchor)
    best = sliding_argmin(subs, width - anchor + 1)
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    valid = text_of[: len(best)] == text_of[width - 1 :]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    m, t = best[starts], text_of[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    content = Rolling(symbols[1], 1).slices(begin, begin + n + width - 1)
    return {
        "text": t[first],
        "start": begin - at[t[first]],
        "n": n,
        "off": m[first] - begin,
        "h": subs[m[first]].view(np.int64),
        "c": content.view(np.int64),
    }


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which of ``length`` symbols lie in one of the ranges."""
    edge = np.bincount(starts, minlength=length + 1) - np.bincount(ends, minlength=length + 1)
    return np.cumsum(edge[:length]) > 0


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column (text) compressed by row, so that a shuffle of texts moves fewer bytes; null is empty."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        last = batch.num_columns - 1
        data, at = flat(batch.column(last))
        view = memoryview(np.ascontiguousarray(data))
        packed = [squeeze(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:last], pa.array(packed, pa.binary())], names=batch.schema.names[:last] + ["packed"]
        )


def unpack(column: pa.Array) -> list[bytes]:
    """Texts of a packed column."""
    return [zstandard.ZstdDecompressor().decompress(x) for x in column.to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``flat``, of unpacked texts."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), at


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + n), one after another."""
    if not len(n):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1])


def without(frame: DataFrame, text: str) -> tuple[Column, str]:
    """Struct of all columns with a null in place of the text, and its type; the text itself travels packed beside it."""
    slim = F.struct(*[F.lit(None).cast(c.dataType).alias(c.name) if c.name == text else F.col(c.name) for c in frame.schema])
    return slim, frame.select(slim.alias("row")).schema["row"].dataType.simpleString()
