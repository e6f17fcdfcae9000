"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are counted on the whole text, vectorised over a batch of documents. The trees are grown on the driver from at most
``sample`` labelled rows (a fixed hash order of doc_id chooses them; the bound limits what the driver and each task hold). All trees
have one depth and are flattened into arrays of features, thresholds and leaf values, so that a batch goes down all trees at once.

Defined results: a null or empty text has statistics of zero and a score like any other; a row with a null doc_id is scored and
is not held out; rows that repeat a doc_id are scored each; a doc_id that is labelled twice counts with its lower label; without
any usable label every score is 0.5; extra columns are not read, so their names cannot clash. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textops

SAMPLE = 20_000
THRESHOLD = 0.3

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "space": (9, 10, 11, 12, 13, 32),
    "stop": b".", "comma": b",", "shout": b"!", "ask": b"?", "bar": b"|", "star": b"*", "money": b"$", "percent": b"%", "hash": b"#",
    "amp": b"&", "dash": b"-", "under": b"_", "colon": b":;", "quote": b"'\"", "bracket": b"()[]", "brace": b"{}", "angle": b"<>",
    "slash": b"/\\", "equal": b"=+", "at": b"@", "control": (*range(0, 9), *range(14, 32), 127),
}
FEATURES = (
    "bytes", "words", "word_mean", "word_spread", "long_words", "distinct_words", "top_word", "distinct_pairs", "distinct_runs", "lines",
    "line_mean", "short_lines", "distinct_lines", "marked_words", *_GROUPS,
)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(codes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different codes per text, and the count of the most frequent one."""
    order = np.lexsort((codes, owner))
    c, o = codes[order], owner[order]
    new = np.ones(len(c), dtype=bool)
    new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(texts)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(c))))
    return np.bincount(o[first], minlength=texts), most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row per text, one column per name in ``FEATURES``."""
    texts = len(at) - 1
    size = np.diff(at)
    one = np.maximum(size, 1)
    out: dict[str, np.ndarray] = {"bytes": np.log1p(size)}
    kind = np.full(256, len(_GROUPS), dtype=np.intp)
    for i, members in enumerate(_GROUPS.values()):
        kind[list(members)] = i
    owner = np.repeat(np.arange(texts), size)
    table = np.bincount(owner * (len(_GROUPS) + 1) + kind[data], minlength=texts * (len(_GROUPS) + 1)).reshape(texts, -1)
    out |= {name: table[:, i] / one for i, name in enumerate(_GROUPS)}
    starts, ends, first = textops.words(data, at)
    n = np.diff(first)
    many = np.maximum(n, 1)
    length = (ends - starts).astype(np.float64)
    mean = _per_text(length, first) / many
    out["words"], out["word_mean"] = np.log1p(n), mean
    out["word_spread"] = np.sqrt(np.maximum(_per_text(length**2, first) / many - mean**2, 0))
    out["long_words"] = _per_text(length > 15, first) / many
    codes = textops.word_codes(data, starts, ends)
    of_word = np.repeat(np.arange(texts), n)
    different, most = _distinct(codes, of_word, texts)
    out["distinct_words"], out["top_word"] = different / many, most / many
    rolling = textops.Rolling(codes, 0)
    for name, k in (("distinct_pairs", 2), ("distinct_runs", 5)):
        runs = rolling.windows(k)
        inside = of_word[: len(runs)] == of_word[k - 1 :] if len(runs) else np.zeros(0, dtype=bool)
        different, _ = _distinct(runs[inside], of_word[: len(runs)][inside], texts)
        out[name] = np.where(n >= k, different / np.maximum(n - k + 1, 1), 1.0)
    last = data[ends - 1] if len(ends) else data[:0]
    out["marked_words"] = _per_text(~(((last | 32) >= 97) & ((last | 32) <= 122)) & (last < 128), first) / many
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1][size > 0], breaks[breaks + 1 < len(data)] + 1])).astype(np.int64)
    stop = np.append(begin[1:], len(data))
    of_line = np.searchsorted(at, begin, side="right") - 1
    lines = np.bincount(of_line, minlength=texts)
    some = np.maximum(lines, 1)
    bytes_rolling = textops.Rolling(textops.CODES[0][data], 0)
    # without the line feed, so that the last line can equal others
    bare = np.where((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(data) else stop
    different, _ = _distinct(bytes_rolling.slices(begin, bare), of_line, texts)
    out["lines"], out["line_mean"] = np.log1p(lines), np.log1p(size / some)
    out["short_lines"] = np.bincount(of_line, weights=(stop - begin) < 30, minlength=texts) / some
    out["distinct_lines"] = different / some
    return np.column_stack([out[name] for name in FEATURES]).astype(np.float64)


@dataclass
class Trees:
    """Trees of one depth: inner nodes level by level (feature, threshold), then the leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row; all trees advance together."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        row = np.arange(len(x))[:, None]
        tree = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), dtype=np.intp)
        while node[0, 0] < inner if len(x) else False:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.start + self.leaf[tree, node - inner].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, calm: float = 5.0) -> Trees:
    """Boosting on the logistic loss with gradient and curvature histograms; ``calm`` is added to the curvature of a leaf."""
    n, width = x.shape if x.ndim == 2 else (0, 0)
    inner = (1 << depth) - 1
    if not n or y.min() == y.max():
        share = 0.0 if not n else (4.0 if y[0] else -4.0)
        return Trees(np.zeros((0, inner), np.intp), np.zeros((0, inner)), np.zeros((0, inner + 1)), share)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, start)
    out = Trees(np.zeros((trees, inner), np.intp), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.intp)
        for level in range(depth):
            count, first = 1 << level, (1 << level) - 1
            best = np.zeros(count)
            local = node - first
            split = np.full(count, bins)
            for f in range(width):
                key = local * bins + binned[f]
                g = np.bincount(key, weights=slope, minlength=count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(key, weights=curve, minlength=count * bins).reshape(count, bins).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + calm) + (total_g - g) ** 2 / (total_h - h + calm) - total_g**2 / (total_h + calm)
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                for k in np.flatnonzero(value > best + 1e-9):
                    best[k], split[k] = value[k], at[k]
                    out.feature[t, first + k] = f
                    out.threshold[t, first + k] = edges[f][at[k]]
            f = out.feature[t, node]
            node = 2 * node + 1 + (binned[f, np.arange(n)] > split[local])
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (slope, curve))
        out.leaf[t] = rate * g / (h + calm)
        raw += out.leaf[t, leaf]
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the doc_id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Trees:
    """Trees from at most ``sample`` labelled rows that are not held out."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in textops.chunks(batches, "text"):
            table = statistics(data, at)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), listed], names=["y", "x"])

    # the sample is bounded by its size, so it can be sent to all tasks
    taught = documents.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = taught.select("y", "text").mapInArrow(textops.tidy(run), "y int, x array<double>").toArrow()
    x = rows.column("x").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy().astype(np.float64)
    # the order of the rows depends on the tasks; sums of floats should not
    order = np.lexsort((*x.T, y))
    return grow(x[order], y[order])


def classify(documents: DataFrame, trees: Trees, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """row (struct of all columns of ``documents``), score (0 to 1), predicted (1 if the score reaches the threshold).

    Only the texts go to Python, and only scores come back.
    """

    def run(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], names=["text"])
        scores = [trees.score(statistics(data, at)) for _, data, at in textops.chunks(iter([rows]), "text")]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    # a filter on the score must not make a second pass over the texts
    score = F.arrow_udf(run, "double").asNondeterministic()
    scored = documents.select(F.struct("*").alias("row"), score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
