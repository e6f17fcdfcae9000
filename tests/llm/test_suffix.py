"""Suffix-array dedup against brute force: the sorter on small alphabets, the operator on small tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import suffix


def _pack(strings):
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("limit", [16_000_000, 50])
def test_order_and_common_prefixes(seed, limit, tmp_path):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(0, 1 + seed % 4, rng.integers(0, 60)).astype(np.uint8).tobytes() for _ in range(15)]
    strings += [strings[0], b"", b"\x00" * 30, bytes([255]) * 9]
    data, at = _pack(strings)
    width = 200
    sorter = suffix.Induced(data, at, width, str(tmp_path), limit)
    pos, lcp = (np.concatenate(x) for x in zip(*sorter.runs(), strict=True))
    string = np.searchsorted(sorter.firsts, pos, side="right") - 1
    got = [strings[s][p - sorter.firsts[s] :] for s, p in zip(string, pos, strict=True)]
    assert sorted(pos.tolist()) == [f + i for s, f in zip(strings, sorter.firsts, strict=True) for i in range(len(s))]
    assert got == sorted(got, reverse=True)
    for i in range(1, len(got)):
        a, b = got[i - 1], got[i]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[i] == n


def brute(docs, width):
    seen, out = {}, {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        body = (text or "").encode()
        gone = np.zeros(len(body), dtype=bool)
        for i in range(len(body) - width + 1):
            w = body[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen[w] = True
        out[doc_id] = bytes(np.frombuffer(body, np.uint8)[~gone]), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_removes_what_starts_earlier(spark, seed):
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list("abcdé \n"), rng.integers(90, 400))) for _ in range(6)]
    docs = []
    for i in rng.permutation(60):
        parts = [
            passages[rng.integers(6)][rng.integers(40) :] if rng.random() < 0.5 else "".join(rng.choice(list("abcdé "), rng.integers(200)))
            for _ in range(rng.integers(5))
        ]
        docs.append((int(i), "".join(parts)))
    docs += [(100, None), (101, ""), (102, "x" * 5000), (103, "x" * 130), (104, "y" * 99)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n long, kept int").repartition(5)
    got = {r["row"]["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(frame).collect()}
    assert got == brute(docs, 100)


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert suffix.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "".join(map(str, range(200)))
    rows = [(None, long), (1, long), (1, long), (2, long), (None, None)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, len(long))]


def test_frequent_line_among_other_text(spark):
    """A line shorter than a window in every document: one anchor with a different piece each, opened, in shards of several units."""
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line, long = noise(60), noise(115)
    docs = [(i, noise(90) + (line if i % 3 else long) + noise(90) + (line[:50] + "tail" + noise(60)) * (i % 2)) for i in range(240)]
    docs += [(300 + i, docs[i][1][40:260]) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = brute(docs, 100)
    for unit, heavy in ((3_000, 1_000), (1, 10_000), (5_000, 0), (1 << 20, 1 << 20)):
        out = suffix.remove_repeats(frame, unit=unit, heavy=heavy)
        got = {r["row"]["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in out.collect()}
        assert got == want


def test_anchors_beyond_the_bound_are_marked_once():
    n = 50
    cols = {"h": np.repeat([3, 7, 9], [n, 2, n]), "c": np.arange(2 * n + 2), "doc_id": np.arange(2 * n + 2)}
    cols |= {"start": cols["c"] * 0, "n": cols["c"] * 0 + 69, "off": cols["c"] * 0}
    batch = suffix._batch(cols)
    for step in (1, 7, 200):
        parts = [batch.slice(i, step) for i in range(0, batch.num_rows, step)]
        out = [r for b in suffix._match(100, 20 * 168)(iter(parts)) for r in b.to_pylist()]
        assert sorted(r["h"] for r in out if r["off"] == suffix.HEAVY) == [3, 9]
        assert sorted(r["doc_id"] for r in out if r["off"] >= 0) == list(range(2 * n + 2))


def test_units_are_bounded_and_hold_whole_anchors():
    rng = np.random.default_rng(1)
    k = np.sort(rng.integers(0, 300, 2_000))
    texts = [bytes(rng.integers(0, 255, 168, dtype=np.uint8)) for _ in k]
    units, got = suffix.Units(5_000), []
    for lo in range(0, len(k), 130):
        part = slice(lo, lo + 130)
        got += units.add(k[part], np.arange(len(k))[part], k[part] * 0, pa.array(texts[part], pa.binary()))
    got.append(units.take())
    assert [d for unit in got for d in unit[2].tolist()] == list(range(len(k)))
    assert b"".join(unit[0].tobytes() for unit in got) == b"".join(texts)
    assert max(len(unit[0]) for unit in got) < 5_000 + 168 * np.bincount(k).max()
    assert all(k[a[2][-1]] != k[b[2][0]] for a, b in zip(got, got[1:], strict=False))
