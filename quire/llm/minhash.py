"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives the size of each set of word shingles, two order-free sums that identify it, and the keys of its
   bands. Documents with equal sets form a class, represented by its smallest doc_id; copies never become pairs.
2. The classes of a bucket are linked to its smallest one only (a star), so there are fewer candidate edges than bucket rows.
   Edges are confirmed on the full sets.
3. A star can miss a link between two of its rays. Buckets whose rays don't all hang together after step 2 are settled exactly:
   their sets are ordered by rarity, and two sets can only be similar if they share one of their rarest shingles (prefix filter)
   early enough (position filter). Only such pairs of different stars are joined and confirmed.
4. Confirmed links become components by alternating large and small stars, a few joins per round.

The share of linked pairs that never meet in a bucket is below one in a million (see ``banding``); nothing else is approximate.

Defined results: a null or empty text and one without words has an empty set and is linked with nothing; fewer words than a
shingle make one shingle of the whole sequence; sets with so few shingles that only an equal set reaches the threshold get no
bands; a row with a null doc_id has a null component; rows that repeat a doc_id are one node, linked through any of their
texts; an empty table gives an empty result; further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textops
from quire.session import materialize


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the number per text.

    A text of fewer than ``size`` words has its whole sequence as the only shingle; without words it has none.
    """
    data = textops.lower_ascii(data)
    starts, ends, first = textops.words(data, at)
    texts = len(at) - 1
    counts = np.diff(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(texts, dtype=np.int64)
    codes = textops.word_codes(data, starts, ends)
    rolling = textops.Rolling(codes, 0)
    text_of = np.repeat(np.arange(texts), counts)
    windows = rolling.windows(size)
    whole = text_of[: len(windows)] == text_of[size - 1 :] if len(windows) else np.zeros(0, dtype=bool)
    short = np.flatnonzero((counts > 0) & (counts < size))
    values = np.concatenate([windows[whole], rolling.slices(first[short], first[short] + counts[short])])
    owner = np.concatenate([text_of[: len(windows)][whole], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.bincount(owner, minlength=texts)


def probe_table(bins: int) -> np.ndarray:
    """For each bin an order of all bins in which a filled one is looked for."""
    grid = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins) + np.uint64(0x51ED27)
    return np.argsort(textops.mix(grid), axis=1)


def signatures(values: np.ndarray, counts: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """Smallest hash per bin and text; an empty bin takes the value of the first filled bin of its own probe order."""
    texts = len(counts)
    owner = np.repeat(np.arange(texts), counts)
    bin_of = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    slot = owner * bins + bin_of.astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    out = np.zeros(texts * bins, dtype=np.uint64)
    full = np.zeros(texts * bins, dtype=bool)
    out[slot[first]] = values[first]
    full[slot[first]] = True
    out, full = out.reshape(texts, bins), full.reshape(texts, bins)
    row, col = np.nonzero(~full & (counts > 0)[:, None])
    for lo in range(0, len(row), 1 << 16):
        r, c = row[lo : lo + (1 << 16)], col[lo : lo + (1 << 16)]
        source = probes[c, np.argmax(full[r[:, None], probes[c]], axis=1)]
        out[r, c] = out[r, source]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per text and band; the number of the band is mixed in."""
    texts, bins = signature.shape
    bands = bins // rows
    grouped = signature.reshape(texts, bands, rows)
    key = np.broadcast_to(textops.mix(np.arange(1, bands + 1, dtype=np.uint64)), (texts, bands)).copy()
    for i in range(rows):
        key = textops.mix((key ^ grouped[:, :, i]) * np.uint64(0x9E3779B97F4A7C15))
    return key


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands) that miss a pair at the threshold with a probability below one in a million."""
    rows = 5 if percent >= 85 else 4 if percent >= 75 else 3
    return rows, math.ceil(math.log(2e-8) / math.log(1 - (percent / 100) ** rows))


def describe(rows: int, bands: int, least: int, size: int = 5):  # type: ignore[no-untyped-def]
    """Per document: doc_id, n (size of the set), two order-free sums of its hashes, keys of its bands (none below ``least``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = probe_table(rows * bands)
        for batch, data, at in textops.chunks(batches, "text"):
            values, counts = shingle_sets(data, at, size)
            first = np.concatenate([[0], np.cumsum(counts)])
            sums = []
            for salt in (0x1B873593, 0x2545F491):
                total = np.concatenate([[np.uint64(0)], np.cumsum(textops.mix(values ^ np.uint64(salt)))])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            wide = counts >= least
            keys = band_keys(
                signatures(values[np.repeat(wide, counts)], counts[wide], rows * bands, probes), rows
            ).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(wide, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(counts),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n", "s1", "s2", "keys"],
            )

    return run


def _full_sets(size: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in textops.chunks(batches, "text"):
            values, counts = shingle_sets(data, at, size)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["node", "s"])

    return run


def _confirm(percent: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i) for i in (2, 3))
            keep = np.zeros(batch.num_rows, dtype=bool)
            a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
            fa, fb = (x.offsets.to_numpy() for x in (left, right))
            for i in range(batch.num_rows):
                x, y = a[fa[i] : fa[i + 1]], b[fb[i] : fb[i + 1]]
                if not len(x) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _prefixes(percent: int):  # type: ignore[no-untyped-def]
    """Of each set the shingles among its rarest ones that also stand in other sets: h, node, size, place in the order of rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(2)
            offsets = shared.offsets.to_numpy().astype(np.int64)
            count = shared.values.field(0).to_numpy(zero_copy_only=False)
            h = shared.values.field(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = slice(offsets[0], offsets[-1])
            count, h = count[at], h[at]
            order = np.lexsort((h, count, row))
            n = batch.column(1).to_numpy(zero_copy_only=False)
            # shingles of no other set come first, the shared ones after them
            place = np.arange(len(row)) - (offsets[:-1] - offsets[0])[row] + (n - np.diff(offsets))[row]
            keep = place < (n + (-percent * n) // 100 + 1)[row]
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (h[order][keep], nodes[row][keep], n[row][keep], place[keep])],
                names=["h", "node", "n", "place"],
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node that can be reached) for all ends of ``edges`` (a, b: two different numbers).

    Large star: all larger neighbours of a node are hung on its smallest one; small star: so are the smaller ones. Repeated
    until nothing changes, which takes a logarithmic number of rounds.
    """

    def hung(pairs: DataFrame) -> DataFrame:
        """(node, its smallest neighbour or itself) for each neighbour."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low, "u").withColumn("m", F.least("u", "m"))

    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        large = hung(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = hung(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        now = materialize(small.where("u <> v").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )


def near_duplicates(documents: DataFrame, percent: int = 85, size: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row: linked if 100 * intersection >= percent * union of the shingle sets."""
    rows, bands = banding(percent)
    least = math.ceil(percent / (100 - percent))  # a set of fewer shingles is similar to none but its equals
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = materialize(
        docs.mapInArrow(textops.tidy(describe(rows, bands, least, size)), "doc_id long, n long, s1 long, s2 long, keys array<long>"), "minhash"
    )
    classes = materialize(
        described.where("n > 0 and doc_id is not null")
        .groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys")),
        "classes",
    )
    banded = classes.select(F.explode("keys").alias("key"), "node", "n")
    stars = banded.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    members = materialize(banded.join(stars, "key").drop("n"), "buckets")
    wanted = members.select("node").distinct()
    sets = materialize(
        docs.join(wanted, docs["doc_id"] == wanted["node"], "left_semi").mapInArrow(
            textops.tidy(_full_sets(size)), "node long, s array<long>"
        ),
        "sets",
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"
        )
        return full.select("a", "b", "sa", "sb").mapInArrow(textops.tidy(_confirm(percent)), "a long, b long")

    rays = members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    linked = materialize(confirmed(rays), "links")
    # a node goes by the smallest center that it is linked to; two nodes with one name hang together
    named = linked.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("name"))
    names = members.join(named, "node", "left").withColumn("name", F.coalesce("name", "node"))
    open_keys = names.groupBy("key").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x <> y").select("key")
    rest = materialize(names.join(open_keys, "key", "left_semi").select("node", "name").distinct(), "rest")
    spread = sets.join(rest.select("node"), "node", "left_semi").select("node", F.explode("s").alias("h"))
    common = spread.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = spread.join(common, "h").groupBy("node").agg(F.collect_list(F.struct("k", "h")).alias("shared"))
    sized = shared.join(sets.select("node", F.size("s").cast("long").alias("n")), "node").select("node", "n", "shared")
    early = materialize(
        sized.mapInArrow(textops.tidy(_prefixes(percent)), "h long, node long, n long, place long").join(rest, "node"), "prefixes"
    )
    mixed = early.groupBy("h").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x <> y").select("h")
    early = early.join(mixed, "h", "left_semi")
    x, y = early.alias("x"), early.alias("y")
    enough = (100 + percent) * F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= percent * (
        F.col("x.n") + F.col("y.n")
    )
    apart = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.name") != F.col("y.name"))
    pairs = x.join(y, apart & enough).select(F.col("x.node").alias("b"), F.col("y.node").alias("a")).distinct()
    found = components(linked.union(confirmed(pairs).select("a", "b")))
    of_class = classes.select("n", "s1", "s2", "node").join(found, "node", "left")
    of_class = of_class.select("n", "s1", "s2", F.coalesce("component", "node").alias("component_id"))
    joined = described.drop("keys").join(of_class, ["n", "s1", "s2"], "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
