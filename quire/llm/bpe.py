"""Byte-level BPE encoding and decoding of whole texts, without regular expressions.

1. Code points become classes by one table lookup; a class with what follows it (one or two places ahead) is a symbol.
2. The tokenizer's split pattern is an automaton over symbols. A block of text is a transition function (state before -> state
   after); functions of blocks are composed by an associative scan, then every block is replayed from its known first state.
   All blocks of a chunk advance together, so nothing walks through a text character by character in Python.
3. The slices between boundaries are looked up in a bounded cache; missing ones are merged pair by pair, lowest rank first.
4. Ids, and for each id the byte offset at which it starts, are gathered for the whole chunk; decoding gathers bytes by id.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter and is read by each Python worker once.

Defined results: a null or empty text has no ids and decodes to nothing; rows are independent, so repeated rows, null ids and an
empty table need no care; extra columns keep their names inside the struct ``row``. Memory follows the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textops

CACHE = 32 << 20
ENTRY = 160
TEXT = 1 << 19
BLOCK = 128

# White space of the pattern, and letters and numbers of Unicode 16 that older tables don't have.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)

OTHER, LETTER, NUMBER, SPACE, BLANK, MARK = range(6)  # BLANK: the plain space; MARK: the apostrophe
# symbols: letters, numbers, others, apostrophes of a contraction of one or two letters, white space before more white space or
# the end, the plain space before something else, other white space before something else
S_LETTER, S_NUMBER, S_OTHER, S_ONE, S_TWO, S_RUN, S_JOIN, S_ALONE = range(8)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_RUN, CLOSED, ONE_MORE, TWO_MORE = range(9)
STATES = 9
FRESH = 8  # added to the symbol of the first character of a text


def class_table() -> np.ndarray:
    """Class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for table, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for lo, hi in table:
            out[lo : hi + 1] = kind
    out[list(SPACES)] = SPACE
    out[0x20], out[0x27] = BLANK, MARK
    return out


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice begins) by symbol and state."""
    step = np.zeros((2 * FRESH, STATES), dtype=np.uint8)
    begins = np.ones((2 * FRESH, STATES), dtype=bool)
    into = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_ONE: ONE_MORE, S_TWO: TWO_MORE}
    into |= {S_RUN: IN_RUN, S_JOIN: JOINING, S_ALONE: CLOSED}
    for symbol, state in into.items():
        step[[symbol, symbol + FRESH]] = state
    joins = [(S_LETTER, IN_LETTERS, IN_LETTERS), (S_NUMBER, IN_NUMBERS, IN_NUMBERS), (S_RUN, IN_RUN, IN_RUN)]
    joins += [(S_LETTER, JOINING, IN_LETTERS), (S_NUMBER, JOINING, IN_NUMBERS)]
    joins += [(S_LETTER, ONE_MORE, CLOSED), (S_LETTER, TWO_MORE, ONE_MORE)]
    joins += [(s, state, IN_OTHERS) for s in (S_OTHER, S_ONE, S_TWO) for state in (IN_OTHERS, JOINING)]
    for symbol, state, after in joins:
        step[symbol, state], begins[symbol, state] = after, False
    return step.ravel(), begins.ravel()


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend((class_table(), *transitions()))
    return _TABLES


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where slices begin; ``first`` has the places at which texts begin (ascending, without empty texts)."""
    classes, step, begins = _tables()
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = np.append(classes[points], [OTHER] * 2)
    last = np.zeros(n, dtype=bool)
    last[first[1:] - 1] = True
    last[-1] = True
    letter = np.append(points, [0, 0])
    one, two = letter[1:-1], letter[2:]
    blank = kind >= SPACE
    blank[kind == MARK] = False
    stays = blank[:n] & (blank[1 : n + 1] | last)
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_ALONE, S_JOIN, S_OTHER], dtype=np.uint8)[kind[:n]]
    symbol[stays] = S_RUN
    mark = np.flatnonzero(kind[:n] == MARK)
    a, b = one[mark], two[mark]
    near = ~last[mark]
    far = near & ~last[np.minimum(mark + 1, n - 1)]
    single = near & np.isin(a, [ord(c) for c in "stmd"])
    double = far & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    symbol[mark[single]] = S_ONE
    symbol[mark[double]] = S_TWO
    symbol[first] += FRESH
    # transition function of each block, composed over blocks, then the replay
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, S_OTHER, dtype=np.intp)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T) * STATES
    function = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for j in range(BLOCK):
        function = step[columns[j][:, None] + function]
    hop = 1
    while hop < rows:
        later = np.take_along_axis(function[hop:], function[:-hop].astype(np.intp), axis=1)
        function = np.concatenate([function[:hop], later])
        hop *= 2
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = function[:-1, START]
    opens = np.empty((BLOCK, rows), dtype=bool)
    for j in range(BLOCK):
        at = columns[j] + state
        opens[j] = begins[at]
        state = step[at]
    return np.flatnonzero(opens.T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: neighbours of the lowest rank are merged first, the leftmost of equals."""
    if len(piece) > 100:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    pair = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i] += parts[i + 1]
        del parts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts, for slices of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once it is merged away
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, i in self.ranks.items():
            tokens[i] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.held = 0  # about as many bytes
        self.ids, self.first = array("i"), array("q", [0])

    def _rows(self, slices: list[bytes]) -> np.ndarray:
        rows = list(map(self.cache.get, slices))
        if None in rows:
            cache, ranks, ids, first = self.cache, self.ranks, self.ids, self.first
            for i, row in enumerate(rows):
                if row is None:
                    piece = slices[i]
                    row = cache.get(piece)
                    if row is None:
                        whole = ranks.get(piece)
                        ids.extend(merge(piece, ranks) if whole is None else (whole,))
                        row = cache[piece] = len(first) - 1
                        self.held += len(piece) + ENTRY
                        first.append(len(ids))
                    rows[i] = row
        return np.array(rows, dtype=np.int64)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, their byte offsets in their text, and the number of ids per text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
        if self.held > CACHE:
            self._forget()
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each code point
        filled = at[:-1][np.diff(at) > 0]
        cuts = leads[boundaries(points, np.searchsorted(leads, filled))]
        stops = np.append(cuts[1:], len(data))
        rows = self._rows([raw[a:b] for a, b in zip(cuts.tolist(), stops.tolist(), strict=True)])
        first = np.frombuffer(self.first, dtype=np.int64)
        per_slice = first[rows + 1] - first[rows]
        ids = np.frombuffer(self.ids, dtype=np.int32)[textops.ranges(first[rows], per_slice)]
        ends = np.cumsum(self.length[ids])
        begin = ends - self.length[ids]
        which = np.searchsorted(begin, at)
        return ids, begin - np.repeat(at[:-1], np.diff(which)), np.diff(which)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after another."""
        return self.bytes[textops.ranges(self.start[ids], self.length[ids])]


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _row_type(frame: DataFrame) -> str:
    return frame.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()


def encode(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """row (struct of all columns), ids (array<int>), offsets (array<int>: byte at which each id starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for rows, data, at in textops.chunks(batches, "text"):
            ids, begin, counts = own.encode(data, at)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), _lists(ids, counts), _lists(begin, counts)], names=["row", "ids", "offsets"]
            )

    rows = documents.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(textops.tidy(run), f"row {_row_type(documents)}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``encoded`` inside ``row``, and text (binary) of its column ids; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype=np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["row", "text"])

    rows = encoded.select(F.struct("*").alias("row"), "ids")
    return rows.mapInArrow(textops.tidy(run), f"row {_row_type(encoded)}, text binary")


def round_trip(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the bytes that the ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        decimals = [b"%d " % i for i in range(len(own.length))]
        width = np.array([len(d) for d in decimals], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(width)[:-1]])
        digits = np.frombuffer(b"".join(decimals), dtype=np.uint8)
        for rows, data, at in textops.chunks(batches, "text", limit=TEXT):
            ids, _, counts = own.encode(data, at)
            last = np.concatenate([[0], np.cumsum(counts)])
            listed = memoryview(digits[textops.ranges(begin[ids], width[ids])])
            line = np.concatenate([[0], np.cumsum(width[ids])])[last].tolist()
            decoded = memoryview(own.decode(ids))
            back = np.concatenate([[0], np.cumsum(own.length[ids])])[last].tolist()
            digest = [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(line[:-1], line[1:], strict=True)]
            again = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(back[:-1], back[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts), pa.array(digest), pa.array(again)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        textops.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
