"""Boosted trees: flattened traversal against a walk node by node, statistics by hand, held-out accuracy, odd rows."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from quire.llm import quality
from quire.llm.queries import op2_quality

SF = "/root/testdata/sf0.01"


def stats(*texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    table = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), at)
    return [dict(zip(quality.FEATURES, row, strict=True)) for row in table]


def test_statistics_by_hand():
    a, empty, b = stats("One two two\nOne two two\n", "", "x! y!")
    assert a["words"] == pytest.approx(np.log(7)) and a["distinct_words"] == pytest.approx(2 / 6)
    assert a["top_word"] == pytest.approx(4 / 6) and a["distinct_lines"] == pytest.approx(1 / 2)
    assert a["upper"] == pytest.approx(2 / 24) and b["shout"] == pytest.approx(2 / 5) and b["marked_words"] == 1
    assert empty["bytes"] == empty["words"] == empty["lines"] == 0
    alone = stats("x! y!")[0]
    assert alone == b


def test_traversal_follows_the_nodes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grow(x, y, trees=20, depth=3)
    want = []
    for row in x:
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        want.append(1 / (1 + np.exp(-total)))
    assert np.allclose(trees.score(x), want)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97


def test_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (None, "c", 4), (2, None, 5), (2, "", 6), (2, "z " * 9000, 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(docs, quality.fit(docs, none)).collect()
    assert [r["score"] for r in rows] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(docs.limit(0), quality.fit(docs, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in op2_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    out = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert sum(a == b for a, b in out) >= 0.95 * len(out)
