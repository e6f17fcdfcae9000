"""Suffix-array dedup of byte strings: induced sorting of candidate text, in units of bounded size.

1. Every window of ``width`` bytes is assigned to its anchor, the smallest sub-window by hash; runs of windows with one anchor
   are pieces. Equal windows have equal anchors, so all of them meet in one shard (hash of the anchor). Only coordinates and two
   hashes travel. Equal pieces are reduced to the first before the shuffle (per chunk) and after it; later ones are removed whole.
2. Pieces that share an anchor with a different piece go to a shard with their bytes. Spark sorts a shard by anchor (in files where
   it must), and it is read in units: whole anchors, of ``SHARD_BYTES`` and at most one anchor more, so a shard may be far larger
   than memory. An anchor with more than ``ANCHOR_BYTES`` of different pieces (a frequent short line with other text around it) is
   opened: each of its windows goes by two hashes of its own, equal ones are reduced to the first per task and then in order, and
   no bytes of it travel. Equal windows have equal anchors, so they are all opened or all in one unit.
   In a unit the suffixes are sorted by induced sorting: suffixes that start at a local minimum (LMS) are named and ordered in a reduced string, then left- and right-going
   scans induce all others. The scans take batches from a queue per first byte, which is what a priority queue over (first byte,
   order of insertion) gives out; a tuple is (position, common prefix with its predecessor), prefixes being carried along as
   minima. Text, types and minima of a unit are in memory; queues would go to files beyond a bound that a unit doesn't reach. The
   reduced string has too many symbols for batches per symbol; its recursion doubles the compared length instead and ends at
   ``width`` bytes.
3. In the sorted order, runs with common prefixes of at least ``width`` bytes are equal windows; all but the first are removed.

Defined results: a null text is empty, and so has nothing to remove; texts below ``width`` bytes stay whole; a document with a
null doc_id takes no part and stays whole; rows that repeat a doc_id count as one document, and what is found in one of them is
removed from all; an empty table gives an empty result; further columns of the input are not read, so their names cannot clash.
Memory follows the longest text (about 60 bytes for each of its bytes), not the size of a partition.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textops
from quire.session import materialize

ANCHOR = 32
GATHER = 150_000
BATCH = 1 << 20
#: usual size of a shard and of a unit, and how many shards there are at most (beyond that shards grow, and have more units)
SHARD_BYTES, MOST_SHARDS = 3 << 20, 20_000
#: bytes of different pieces of one anchor that are sorted together; beyond that its windows are opened
ANCHOR_BYTES = SHARD_BYTES // 4
#: marks in ``off`` of a removed range and of an anchor to be opened
GONE, HEAVY = -1, -2
_PIECE = "h long, c long, doc_id long, start long, n int, off int"
_SCHEMA = pa.schema(
    [("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32())]
)
_NAMES = tuple(_SCHEMA.names)


def _batch(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name].astype(f.type.to_pandas_dtype())) for f in _SCHEMA], schema=_SCHEMA)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges united per document where they touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), dtype=bool)
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1]))
    # the reach of earlier ranges of the same document
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(group * span + end)
    new[1:] = group[1:] * span + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _reduced(cols: dict[str, np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Equal pieces of one task: the first goes on, the others are removed ranges (off = -1, n bytes)."""
    order = np.lexsort((cols["start"], cols["doc_id"], cols["c"] ^ (cols["h"] * 3)))
    cols = {k: v[order] for k, v in cols.items()}
    same = np.zeros(len(order), dtype=bool)
    same[1:] = True
    for k in ("h", "c", "n", "off"):
        same[1:] &= cols[k][1:] == cols[k][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = (cols["doc_id"] != cols["doc_id"][head]) | (cols["start"] != cols["start"][head])
    yield _batch({k: v[~same] for k, v in cols.items()})
    gone = same & later
    doc, start, end = merged(cols["doc_id"][gone], cols["start"][gone], cols["start"][gone] + cols["n"][gone] + width - 1)
    if len(doc):
        off = np.full(len(doc), -1)
        yield _batch({"h": doc * 0x5851F42D4C957F2D, "c": doc * 0, "doc_id": doc, "start": start, "n": end - start, "off": off})


def _find(width: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0
        for rows, data, at in textops.chunks(batches, "text"):
            got = textops.pieces((textops.CODES[0][data], textops.CODES[1][data]), at, width, ANCHOR)
            ids = rows.column(rows.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            got["doc_id"] = ids[got.pop("text")].astype(np.int64)
            held.append(got)
            count += len(got["h"])
            if count >= GATHER:
                yield from _reduced({k: np.concatenate([x[k] for x in held]) for k in _NAMES}, width)
                held, count = [], 0
        if count:
            yield from _reduced({k: np.concatenate([x[k] for x in held]) for k in _NAMES}, width)

    return run


def _match(width: int, heavy: int):  # type: ignore[no-untyped-def]
    """Rows in the order of (h, c, n, off, doc_id, start): later copies become removed ranges; the first ones go on if their
    anchor has several different pieces. An anchor whose first ones have more than ``heavy`` bytes is given once with off = HEAVY.
    What passes from batch to batch is one row: the last first one, whether it is out, and the bytes of its anchor so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        out, weight = False, 0
        for batch in batches:
            cols = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(_NAMES)}
            ranges = cols["off"] < 0
            if ranges.any():
                yield _batch({k: v[ranges] for k, v in cols.items()})
                cols = {k: v[~ranges] for k, v in cols.items()}
            lead = 0
            if kept is not None:
                cols, lead = {k: np.concatenate([kept[k], v]) for k, v in cols.items()}, 1
            total = len(cols["h"])
            if not total:
                continue
            new = np.ones(total, dtype=bool)
            new[1:] = False
            for k in ("h", "c", "n", "off"):
                new[1:] |= cols[k][1:] != cols[k][:-1]
            firsts = np.flatnonzero(new)
            h = cols["h"][firsts]
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = cols["n"][firsts].astype(np.int64) + width - 1
            before = np.zeros(len(heads), dtype=np.int64)
            if lead:
                size[0], before[0] = 0, weight
            after = before + np.add.reduceat(size, heads)
            weight = int(after[-1])
            full = h[heads[(before <= heavy) & (after > heavy)]]
            if len(full):
                yield _batch({k: np.zeros(len(full), dtype=np.int64) for k in _NAMES} | {"h": full, "off": np.full(len(full), HEAVY)})
            shared = np.zeros(len(firsts), dtype=bool)
            shared[1:] = h[1:] == h[:-1]
            shared[:-1] |= h[1:] == h[:-1]
            if lead and out:
                # the row carried over is out already; what has its anchor is shared, itself it is not given again
                shared |= h == h[0]
            give = shared.copy()
            if lead and out:
                give[0] = False
            if give.any():
                yield _batch({k: v[firsts[give]] for k, v in cols.items()})
            head = np.maximum.accumulate(np.where(new, np.arange(total), 0))
            gone = ~new & ((cols["doc_id"] != cols["doc_id"][head]) | (cols["start"] != cols["start"][head]))
            if gone.any():
                size = int(gone.sum())
                yield _batch(
                    {k: v[gone] for k, v in cols.items()} | {"n": cols["n"][gone] + width - 1, "off": np.full(size, -1)}
                )
            last = firsts[-1]
            kept, out = {k: v[last : last + 1] for k, v in cols.items()}, bool(shared[-1])

    return run


class Fifo:
    """Queue of equally long arrays; what exceeds the shared memory bound waits in a file."""

    held = 0

    def __init__(self, folder: str, kinds: tuple[str, ...], limit: int) -> None:
        self.folder, self.kinds, self.limit = folder, kinds, limit
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.files: list[tuple[str, int]] = []
        self.names = 0

    def push(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.parts.append(tuple(a.astype(k, copy=False) for a, k in zip(arrays, self.kinds, strict=True)))
            Fifo.held += len(arrays[0])
            if Fifo.held > self.limit and sum(len(p[0]) for p in self.parts) > self.limit // 64:
                self._spill()

    def _spill(self) -> None:
        with tempfile.NamedTemporaryFile(dir=self.folder, delete=False) as file:
            count = sum(len(p[0]) for p in self.parts)
            for i in range(len(self.kinds)):
                np.concatenate([p[i] for p in self.parts]).tofile(file)
        Fifo.held -= count
        self.files.append((file.name, count))
        self.parts = []

    def take(self) -> list[tuple[np.ndarray, ...]]:
        """All parts in order of insertion; the queue is empty afterwards."""
        out: list[tuple[np.ndarray, ...]] = []
        for name, count in self.files:
            at, columns = 0, []
            for kind in self.kinds:
                columns.append(np.memmap(name, dtype=kind, mode="r", offset=at, shape=(count,)))
                at += count * np.dtype(kind).itemsize
            out.append(tuple(columns))
        Fifo.held -= sum(len(p[0]) for p in self.parts)
        out += [tuple(np.concatenate([p[i] for p in self.parts]) for i in range(len(self.kinds)))] if self.parts else []
        self.files, self.parts = [], []
        return out

    def __bool__(self) -> bool:
        return bool(self.parts or self.files)


def _slices(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    for part in parts:
        for lo in range(0, len(part[0]), BATCH):
            yield tuple(np.asarray(a[lo : lo + BATCH]) for a in part)


class Induced:
    """Suffixes of many strings in sorted order (to the depth of ``width`` symbols) with common prefixes, by induced sorting."""

    def __init__(self, data: np.ndarray, at: np.ndarray, width: int, folder: str, limit: int = 16_000_000) -> None:
        self.width = min(width, 65_000)
        self.folder, self.limit = folder, limit
        lengths = np.diff(at)
        n = len(data) + len(lengths)
        padded = np.zeros(n + 4, dtype=np.int16)
        self.text = padded[:n]
        # four symbols at a time, at any position
        self.fours = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(2,))
        ends = at[1:] + np.arange(len(lengths))  # place of the end mark of each string
        body = np.ones(n, dtype=bool)
        body[ends] = False
        self.text[body] = data.astype(np.int16) + 1
        self.marks, self.size = ends, n
        self.firsts = at[:-1] + np.arange(len(lengths))
        kind = np.int32 if n < 1 << 31 else np.int64
        self.position = np.dtype(kind).str
        # distance to the end mark, at least 1 inside a string
        self.room = np.repeat(ends.astype(kind), lengths + 1)
        self.room -= np.arange(n, dtype=kind)
        after = np.zeros(n, dtype=np.int8)
        np.sign(self.text[1:] - self.text[:-1], out=after[:-1], casting="unsafe")
        nxt = np.where(after != 0, np.arange(n, dtype=kind), np.array(n, dtype=kind))
        nxt = np.minimum.accumulate(nxt[::-1], out=nxt[::-1])[::-1]
        self.smaller = np.zeros(n, dtype=bool)  # S-type: smaller than the suffix that follows
        known = nxt < n
        self.smaller[known] = after[nxt[known]] > 0
        self.smaller[ends] = True
        self.smaller[ends[lengths > 0] - 1] = False

    def _prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes, at most ``width``."""
        most = np.minimum(np.minimum(self.room[a], self.room[b]), self.width)
        out = np.zeros(len(a), dtype=np.int32)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        for d in range(0, self.width, 4):
            live = live[d < most[live]]
            if not len(live):
                break
            differ = self.fours[x[live] + d] ^ self.fours[y[live] + d]
            equal = differ == 0
            lowest = differ[~equal] & (~differ[~equal] + np.uint64(1))
            out[live[~equal]] = d + (np.log2(lowest.astype(np.float64)).astype(np.int32) >> 4)
            out[live[equal]] = d + 4
            live = live[equal]
        return np.minimum(out, most)

    def _minima(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of LMS suffixes in sorted order, and their common prefixes with the one before."""
        low = np.zeros(self.size, dtype=bool)
        low[1:] = self.smaller[1:] & ~self.smaller[:-1]
        low[self.firsts] = False
        low[self.marks] = False
        lms = np.flatnonzero(low)
        if not len(lms):
            return lms, np.zeros(0, dtype=np.int32)
        mark = np.searchsorted(self.marks, lms)
        stop = self.marks[mark]
        last = np.append(mark[1:] != mark[:-1], True)
        end = np.where(last, stop, np.append(lms[1:], 0)) + 1
        codes = textops.mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        named = (end - lms).astype(np.uint64)
        for lo in range(0, len(lms), BATCH // 16):
            part = slice(lo, lo + BATCH // 16)
            a, b = lms[part], end[part]
            named[part] += textops.Rolling(codes[self.text[a[0] : b[-1]]], 0).slices(a - a[0], b - a[0])
        _, first, name = np.unique(named, return_index=True, return_inverse=True)
        wide = self.text.astype(">u2")
        keys = [wide[a:b].tobytes() + b"\xff\xff" for a, b in zip(lms[first].tolist(), end[first].tolist(), strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        rank = np.zeros(len(keys), dtype=np.int64)
        rank[order] = np.arange(1, len(keys) + 1)
        rank = rank[name]
        hop = 1
        while hop < self.width and rank.max() < len(lms):
            follow = np.zeros(len(lms), dtype=np.int64)
            follow[:-hop] = np.where(mark[hop:] == mark[:-hop], rank[hop:], 0) if hop < len(lms) else 0
            key = rank * (len(lms) + 1) + follow
            _, rank = np.unique(key, return_inverse=True)
            rank += 1
            hop *= 2
        order = np.argsort(rank, kind="stable")
        ordered = lms[order]
        common = np.zeros(len(ordered), dtype=np.int32)
        common[1:] = self._prefix(ordered[:-1], ordered[1:])
        return ordered, common

    def _induce(self, queues: list[Fifo], least: np.ndarray, at: np.ndarray, common: np.ndarray, keep: np.ndarray) -> None:
        """Push the left neighbours of a sorted batch, where ``keep``; ``least`` has the smallest prefix since the last push."""
        left = at.astype(np.int64) - 1
        to = np.where(keep, self.text[left], 0)
        picks = np.flatnonzero(to)
        below = int(common.min())
        if not len(picks):
            np.minimum(least, below, out=least)
            return
        order = picks[np.argsort(to[picks], kind="stable")]
        kinds = to[order]
        cuts = np.append(np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])), len(order))
        tail = np.minimum.accumulate(common[::-1])[::-1]
        ahead = np.minimum.accumulate(common)
        quiet = np.ones(len(least), dtype=bool)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            idx, c = order[lo:hi], int(kinds[lo])
            got = np.empty(hi - lo, dtype=np.int32)
            got[0] = min(int(least[c]), int(ahead[idx[0]]))
            if hi - lo > 1:
                got[1:] = np.minimum.reduceat(common[: idx[-1] + 1], idx[:-1] + 1)
            least[c] = int(tail[idx[-1] + 1]) if idx[-1] + 1 < len(common) else self.width
            quiet[c] = False
            queues[c].push(left[idx], np.minimum(got + 1, self.width))
        least[quiet] = np.minimum(least[quiet], below)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix with the one before) in descending order of suffixes; the prefix is with the larger one."""
        kinds = (self.position, "<i4")
        new = lambda: [Fifo(self.folder, kinds, self.limit) for _ in range(258)]
        lms, shared = self._minima()
        head = np.searchsorted(self.text[lms], np.arange(259))
        queues, larger = new(), new()
        least = np.zeros(258, dtype=np.int64)  # nothing pushed yet: no common prefix with what stands before
        # every end mark induces the last symbol of its string
        filled = np.flatnonzero(self.room[self.firsts] > 0)
        ends = self.marks[filled]
        self._induce(queues, least, ends, np.zeros(len(ends), dtype=np.int32), np.ones(len(ends), dtype=bool))
        ends_at: dict[int, tuple[int, int]] = {}
        for c in range(1, 258):
            final = -1
            fresh = True
            while queues[c]:
                for at, common in _slices(queues[c].take()):
                    if fresh:
                        common = common.copy()
                        common[0], fresh = 0, False
                    larger[c].push(at, common)
                    left = self.text[at.astype(np.int64) - 1]
                    self._induce(queues, least, at, common, (left >= c) & (at > 0))
                    final = int(at[-1])
            lo, hi = head[c], head[c + 1]
            for lo2 in range(lo, hi, BATCH):
                at, common = lms[lo2 : min(hi, lo2 + BATCH)], shared[lo2 : min(hi, lo2 + BATCH)].copy()
                if lo2 == lo:
                    common[0] = int(self._prefix(np.array([final]), at[:1])[0]) if final >= 0 else 0
                left = self.text[at - 1]
                self._induce(queues, least, at, common, left > c)
        # right to left: all suffixes that are smaller than their successors
        queues = new()
        least = np.zeros(258, dtype=np.int64)
        for c in range(257, 0, -1):
            final = -1
            while queues[c]:
                for at, common in _slices(queues[c].take()):
                    if final < 0:
                        common = common.copy()
                        common[0] = 0
                    yield at, common
                    left = self.text[at.astype(np.int64) - 1]
                    self._induce(queues, least, at, common, (left > 0) & (left <= c) & (at > 0))
                    final = int(at[-1])
            # the larger type of this symbol, from its end; the prefix belongs to the pair with the one that follows
            follow = None
            for at, common in reversed([*_slices(larger[c].take())]):
                back, lcp = at[::-1], np.empty(len(at), dtype=np.int32)
                lcp[1:] = common[::-1][:-1]
                lcp[0] = (
                    follow if follow is not None else int(self._prefix(np.array([final]), back[:1])[0]) if final >= 0 else 0
                )
                follow = int(common[0])
                yield back, lcp
                left = self.text[back.astype(np.int64) - 1]
                self._induce(queues, least, back, lcp, (left > 0) & (left < c) & (back > 0))


def later_windows(
    data: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int, limit: int = 16_000_000
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the bytes in windows of ``width`` bytes that also start earlier, by (doc, start + offset)."""
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    if not len(data):
        return found[0]
    with tempfile.TemporaryDirectory() as folder:
        sorter = Induced(data, at, width, folder, limit)
        tail_at = np.zeros(0, dtype=np.int64)
        for pos, common in sorter.runs():
            pos = pos.astype(np.int64)
            linked = common >= width
            at_all = np.concatenate([tail_at, pos])
            new = np.ones(len(at_all), dtype=bool)
            new[len(tail_at) :] = ~linked
            if len(tail_at):
                new[1 : len(tail_at)] = False
            firsts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            size = np.diff(np.append(firsts, len(at_all)))
            several = size[group] > 1
            several |= group == group[-1]  # may go on in the next batch
            at_all, group = at_all[several], group[several]
            string = np.searchsorted(sorter.firsts, at_all, side="right") - 1
            where = start[string] + at_all - sorter.firsts[string]
            order = np.lexsort((where, doc[string], group))
            at_all, group, string, where = at_all[order], group[order], string[order], where[order]
            d = doc[string]
            head = np.ones(len(order), dtype=bool)
            head[1:] = group[1:] != group[:-1]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            later = (d != d[lead]) | (where != where[lead])
            found.append(merged(d[later], where[later], where[later] + width))
            tail_at = at_all[lead[-1] : lead[-1] + 1]  # the first of the last group stands for it
    return merged(*(np.concatenate([f[i] for f in found]) for i in range(3)))


_SENT = "k long, c long, doc_id long, start long, n long, piece binary"


def _sent(k: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, piece: pa.Array | None = None) -> pa.RecordBatch:
    piece = pa.nulls(len(k), pa.binary()) if piece is None else piece
    longs = [pa.array(np.asarray(x, dtype=np.int64)) for x in (k, c, doc, start, n)]
    return pa.RecordBatch.from_arrays([*longs, piece], names=["k", "c", "doc_id", "start", "n", "piece"])


def _windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The different windows of some pieces by two hashes (n = 0), each where it starts first; the others as removed ranges."""
    data, at = textops.joined(pieces)
    if len(data) < width:
        return
    owner = np.repeat(np.arange(len(pieces)), np.diff(at))
    where = np.flatnonzero(owner[: len(data) - width + 1] == owner[width - 1 :])
    k, c = (textops.Rolling(textops.CODES[i][data], i).windows(width)[where].view(np.int64) for i in (0, 1))
    owner = owner[where]
    doc, start = doc[owner], start[owner] + where - at[owner]
    order = np.lexsort((start, doc, c, k))
    k, c, doc, start = k[order], c[order], doc[order], start[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    yield _sent(k[new], c[new], doc[new], start[new], np.zeros(int(new.sum())))
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    gone = (doc != doc[head]) | (start != start[head])
    d, s, e = merged(doc[gone], start[gone], start[gone] + width)
    if len(d):
        yield _sent(d * 0x5851F42D4C957F2D, d * 0, d, s, e - s)


def _slice(width: int):  # type: ignore[no-untyped-def]
    """The wanted pieces of each document: with their bytes under their anchor, or opened into windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            offsets = wanted.offsets.to_numpy()
            h, start, n, heavy = (wanted.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 256):
                texts = textops.unpack(batch.column(1).slice(lo, 256))
                hi = lo + len(texts)
                inner = slice(offsets[lo], offsets[hi])
                owner = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
                doc, begin, end, opened = docs[lo:hi][owner], start[inner], start[inner] + n[inner] + width - 1, heavy[inner].astype(bool)
                light = np.flatnonzero(~opened)
                cuts = zip(owner[light].tolist(), begin[light].tolist(), end[light].tolist(), strict=True)
                piece = pa.array([texts[i][a:b] for i, a, b in cuts], pa.binary())
                if len(light):
                    yield _sent(h[inner][light], light * 0, doc[light], begin[light], light * 0, piece)
                opened = np.flatnonzero(opened)
                block = np.cumsum(end[opened] - begin[opened]) // textops.CHUNK
                for part in np.split(opened, np.flatnonzero(block[1:] != block[:-1]) + 1) if len(opened) else ():
                    cuts = zip(owner[part].tolist(), begin[part].tolist(), end[part].tolist(), strict=True)
                    yield from _windows([texts[i][a:b] for i, a, b in cuts], doc[part], begin[part], width)

    return run


class Units:
    """Pieces in the order of their anchors, gathered to units of whole anchors."""

    def __init__(self, bound: int) -> None:
        self.bound = bound
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size, self.last = 0, 0

    def add(self, k: np.ndarray, doc: np.ndarray, start: np.ndarray, piece: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        reach = np.cumsum(np.diff(textops.flat(piece)[1]))
        ahead = np.append(0, reach[:-1])
        cuts = np.flatnonzero(k != np.append(self.last, k[:-1]))
        lo = done = 0
        for cut in cuts.tolist():
            if self.size + ahead[cut] - done >= self.bound and (self.held or cut):
                self.held.append((piece.slice(lo, cut - lo), doc[lo:cut], start[lo:cut]))
                yield self.take()
                lo, done = cut, int(ahead[cut])
        self.held.append((piece.slice(lo), doc[lo:], start[lo:]))
        self.size += int(reach[-1]) - done
        self.last = k[-1]

    def take(self) -> tuple[np.ndarray, ...]:
        """data, at, doc, start of what is held."""
        parts = [textops.flat(p) for p, _, _ in self.held]
        data = np.concatenate([p[0] for p in parts])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        doc, start = (np.concatenate([x[i] for x in self.held]) for i in (1, 2))
        self.held, self.size = [], 0
        return data, at, doc, start


def _sort_shard(width: int, bound: int):  # type: ignore[no-untyped-def]
    """A shard in the order of (piece is null, k, c, doc_id, start): units of pieces are sorted; of equal windows the later ones are
    removed; ranges pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(bound)
        kept: tuple[np.ndarray, ...] | None = None

        def out(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(n)], names=["doc_id", "start", "n"])

        def ranges(unit: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            d, s, e = later_windows(*unit, width)
            return out(d, s, e - s)

        for batch in batches:
            k, c, doc, start, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            piece = batch.column(5)
            full = piece.is_valid().to_numpy(zero_copy_only=False)
            if full.any():
                at = np.flatnonzero(full)
                for unit in units.add(k[at], doc[at], start[at], piece.filter(pa.array(full))):
                    yield ranges(unit)
            if (n > 0).any():
                yield out(doc[n > 0], start[n > 0], n[n > 0])
            at = np.flatnonzero(~full & (n == 0))
            if not len(at):
                continue
            cols = tuple(x[at] for x in (k, c, doc, start))
            if kept is not None:
                cols = tuple(np.concatenate([a, b]) for a, b in zip(kept, cols, strict=True))
            k, c, doc, start = cols
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            gone = (doc != doc[head]) | (start != start[head])
            d, s, e = merged(doc[gone], start[gone], start[gone] + width)
            yield out(d, s, e - s)
            kept = tuple(x[head[-1] : head[-1] + 1] for x in cols)
        if units.held:
            yield ranges(units.take())

    return run


def repeated_ranges(
    documents: DataFrame, width: int = 100, text: str = "text", unit: int = SHARD_BYTES, heavy: int = ANCHOR_BYTES
) -> DataFrame:
    """doc_id, start, n: byte ranges that hold only windows which also start earlier. Ranges of a document may overlap.

    ``unit`` and ``heavy`` are the bytes sorted at a time and those of one anchor among them; the result doesn't depend on them.
    """
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    found = docs.where(F.octet_length("text") >= width).mapInArrow(textops.tidy(_find(width)), _PIECE)
    ordered = found.repartition("h").sortWithinPartitions("h", "c", "n", "off", "doc_id", "start")
    matched = materialize(ordered.mapInArrow(textops.tidy(_match(width, heavy)), _PIECE).drop("c"), "suffix-pieces")
    first = matched.where("off >= 0")
    total, opened = matched.agg(
        F.sum(F.when(F.col("off") >= 0, F.col("n") + (width - 1))), F.count(F.when(F.col("off") == HEAVY, 1))
    ).first()
    first = first.withColumn("heavy", F.lit(False))
    if opened:
        marks = matched.where(F.col("off") == HEAVY).select("h", F.lit(True).alias("_heavy"))
        first = first.join(marks, "h", "left").withColumn("heavy", F.coalesce("_heavy", F.lit(False)))
    reps = first.groupBy("doc_id").agg(F.collect_set(F.struct("h", "start", "n", "heavy")).alias("p"))
    packed = docs.mapInArrow(textops.tidy(textops.pack), "doc_id long, packed binary")
    sent = packed.join(reps, "doc_id").mapInArrow(textops.tidy(_slice(width)), _SENT)
    parts = min(MOST_SHARDS, max(1, -(-(total or 0) // SHARD_BYTES)))
    shards = sent.repartition(parts, "k").sortWithinPartitions(F.col("piece").isNull(), "k", "c", "doc_id", "start")
    sorted_out = shards.mapInArrow(textops.tidy(_sort_shard(width, unit)), "doc_id long, start long, n long")
    gone = matched.where(F.col("off") == GONE)
    return gone.select("doc_id", "start", F.col("n").cast("long")).unionByName(sorted_out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, packed, ranges = (batch.column(i) for i in range(3))
        begin = ranges.offsets.to_numpy()
        fields = ranges.values
        starts = fields.field(0).to_numpy(zero_copy_only=False)
        ends = starts + fields.field(1).to_numpy(zero_copy_only=False)
        kept, sizes, removed, spans = [], [], [], []
        for i in range(batch.num_rows):
            text = textops.unpack(packed.slice(i, 1))[0]
            lo, hi = begin[i], begin[i + 1]
            sizes.append(len(text))
            if lo == hi:
                kept.append(text)
                removed.append(0)
                spans.append(0)
                continue
            gone = textops.covered(np.minimum(starts[lo:hi], len(text)), np.minimum(ends[lo:hi], len(text)), len(text))
            kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
        yield pa.RecordBatch.from_arrays(
            [row, pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))],
            names=["row", "kept", "n_bytes", "n_removed", "n_spans"],
        )


def remove_repeats(
    documents: DataFrame, width: int = 100, text: str = "text", unit: int = SHARD_BYTES, heavy: int = ANCHOR_BYTES
) -> DataFrame:
    """row (struct of all columns, the text being null), kept (binary: remaining bytes), n_bytes (before), n_removed, n_spans
    (maximal removed runs).
    """
    ranges = repeated_ranges(documents, width, text, unit, heavy).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("r"))
    slim, kind = textops.without(documents, text)
    rows = documents.select(slim.alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.col(text).alias("text"))
    rows = rows.mapInArrow(textops.tidy(textops.pack), f"row {kind}, _doc long, packed binary")
    joined = rows.join(ranges, F.col("_doc") == F.col("doc_id"), "left")
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    return joined.select("row", "packed", F.coalesce("r", none).alias("r")).mapInArrow(
        textops.tidy(_cut), f"row {kind}, kept binary, n_bytes long, n_removed long, n_spans long"
    )
