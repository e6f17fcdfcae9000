"""Stages of the pipeline one after another against brute force on what each one is given."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import pytest
from test_bpe import library  # noqa: F401
from test_minhash import brute as near_brute
from test_suffix import brute as suffix_brute

import corpus_pipeline as cp
from quire.llm import mixing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(5000, None, "en", "src1", None, 1), (5001, "", None, None, 0, 2), (None, "No id at all, but a clean text. " * 9, "en", "src2", 9, 3)],
        "doc_id long, text string, lang string, source string, n_chars long, score int",
    )
    docs = docs.unionByName(extra, allowMissingColumns=True)
    before = docs.collect()
    steps = dict(cp.STAGES)
    good = steps["quality"](spark, docs, SF).cache()
    assert good.columns == list(cp.COLUMNS)
    rows = good.collect()
    assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in before}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in rows}
    assert all(d in left for d, q in labels.items() if q == 1) and sum(d in left for d, q in labels.items() if q == 0) <= 2

    single = steps["near_duplicates"](spark, good, SF).cache()
    comp = near_brute([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 80)
    want = [r for r in rows if r["doc_id"] is None or comp[r["doc_id"]][1] == r["doc_id"]]
    rows = single.collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, want))

    cut = steps["repeated_passages"](spark, single, SF).cache()
    kept = suffix_brute([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 100)
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in rows:
        if r["doc_id"] is not None and r["text"]:
            body = kept[r["doc_id"]][0].decode("utf-8", "ignore")
            assert got.get(r["doc_id"], "") == body
    assert got.get(5000) is None and None in got

    mixed = steps["mixing"](spark, cut, SF).cache()
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in got.items()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(cut).collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert times == Counter({d: n for d, n in copies.items() if n})
    assert sum(sizes[d] * n for d, n in times.items()) == pytest.approx(sum(sizes.values()), rel=0.1)

    ids = steps["token_ids"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in ids) == times
    for r in ids:
        listed = library.encode_ordinary(got[r["doc_id"]] or "")
        assert r["n_tokens"] == len(listed)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest()


def test_rows_that_repeat_id_and_text_stay_once(spark):
    body = "every word of this text stands here once and then it ends at last"
    rows = [(1, body), (1, body), (2, body + " or not"), (3, "quite another text with other words in it"), (3, "third of the same id, again other words"), (3, None), (3, None), (None, body), (None, body)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in dict(cp.STAGES)["near_duplicates"](spark, docs, SF).collect())
    assert got == Counter({(1, body): 1, (3, rows[3][1]): 1, (3, rows[4][1]): 1, (3, None): 1, (None, body): 2})
