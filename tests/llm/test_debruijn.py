"""Word dedup by De Bruijn compaction against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest

from quire.llm import debruijn


def brute(docs, width):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = True
        out[d] = (len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_removes_windows_of_smaller_documents(spark, seed):
    rng = np.random.default_rng(seed)
    vocab = np.array(["a", "the", "é", "of", "Ж"] + [f"w{i}" for i in range(40)])
    passages = [list(rng.choice(vocab, rng.integers(10, 60))) for _ in range(8)]
    docs = []
    for i in rng.permutation(70):
        words = []
        for _ in range(rng.integers(6)):
            p = passages[rng.integers(8)]
            words += p[rng.integers(6) : len(p) - rng.integers(6)] if rng.random() < 0.6 else list(rng.choice(vocab[:4], 20))
        docs.append((int(i), "  \n".join(words)))
    docs += [(100, None), (101, ""), (102, "same " * 400), (103, "same " * 14), (104, "same " * 12)]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, f long, s string").repartition(4)
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in debruijn.remove_repeats(frame).collect()}
    assert got == brute(docs, 13)


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert debruijn.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(map(str, range(50)))
    rows = [(None, long), (1, long), (1, long), (2, long), (None, None)]
    got = debruijn.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 50)]
