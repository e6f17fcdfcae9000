"""Near duplicates against all pairs on small families of texts, and the parts of the signature."""

from __future__ import annotations

import re

import numpy as np
import pytest

from quire.llm import minhash


def brute(docs, percent):
    sets = {}
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}
    ids = sorted(sets)
    links = [
        (a, b)
        for a in ids
        for b in ids
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    for _ in ids:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: (len(sets[d]), comp[d]) for d in ids}


def families(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(3000)]
    docs, d = [], 0
    for _ in range(6):
        words = list(rng.choice(vocab, rng.integers(6, 300)))
        for _ in range(14):
            mine = words.copy()
            for _ in range(rng.integers(0, 1 + len(words) // 60 + 2)):
                mine[rng.integers(len(mine))] = str(rng.choice(vocab))
            docs.append((d, " ".join(mine).title() if rng.random() < 0.2 else "\n".join(mine)))
            words = mine if rng.random() < 0.3 else words  # chains of small changes
            d += 1
    return docs + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  two"), (905, "two one")]


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, percent):
    docs = families(seed)
    frame = spark.createDataFrame([(d, t, 7, 8) for d, t in docs], "doc_id long, text string, n long, node long").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, percent).collect()}
    assert got == brute(docs, percent)


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (9, text), (7, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [
        (0, 4, 0), (5, 4, 5), (5, 4, 5), (7, 0, 7), (9, 4, 5),
    ]


def test_empty_bins_take_from_filled_ones():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 7).astype(np.uint64) * np.uint64(2))
    probes = minhash.probe_table(40)
    out = minhash.signatures(values, np.array([7]), 40, probes)
    assert set(out[0].tolist()) <= set(values.tolist())
    again = minhash.signatures(np.concatenate([values, values]), np.array([7, 7]), 40, probes)
    assert (again[0] == again[1]).all() and (again[0] == out[0]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
