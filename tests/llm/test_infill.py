"""Fill-in-middle against string slicing, and exact round trips."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t ", "word", " word", "word ", "two words", "ünï cödé  \x0b ends ", "a <P> b", "<", "<P", "P>", "<P<S>x", "a b c",
    "x" * 5000, "long text of many words " * 3000, " line　sep words here", "<M", "M>", "tail <", "🙂 🙃  🙂 ok", "same", "same",
]


def test_transform(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS * 12)] + [(None, "no id at all", 1), (3, "repeated id", 2), (3, "repeated id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form int")
    back = infill.restore(infill.transform(docs)).collect()
    got = sorted((str(r["row"]["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in back)
    want = sorted((str(d), *[str(x) if i in (2, 3) else x for i, x in enumerate(brute(d, t))]) for d, t, _ in rows)
    assert got == want
    assert {r["form"] for r in back} == {"plain", "spm", "psm"}
    assert sorted((str(r["row"]["doc_id"]), r["restored"]) for r in back) == sorted((str(d), t or "") for d, t, _ in rows)
    assert {r["row"]["form"] for r in back} >= {0, 1, 2}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restore(infill.transform(docs)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab <>PSM\né中", max_size=12), st.integers(0, 50), st.integers(0, 50), st.integers(0, 2)), max_size=8))
def test_scatter_and_gather(parts):
    blobs = [t.encode() for t, _, _, _ in parts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in blobs], dtype=np.int64)]).astype(np.int64)
    data = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    held = infill.marked(data, at)
    assert held.tolist() == [any(m in x for m in infill.MARKS) for x in blobs]
    ends, first = infill.token_ends(data, at)
    for i, x in enumerate(blobs):
        lengths = [len(t.encode()) for t in TOKEN.findall(x.decode())]
        assert (ends[first[i] : first[i + 1]] - at[i]).tolist() == np.cumsum(lengths).tolist()
    a, b, form = np.zeros(len(parts), int), np.zeros(len(parts), int), np.zeros(len(parts), int)
    for i, (_, x, y, f) in enumerate(parts):
        lo, hi = sorted((x % (len(blobs[i]) + 1), y % (len(blobs[i]) + 1)))
        a[i], b[i], form[i] = at[i] + lo, at[i] + hi, 0 if held[i] or not blobs[i] else f
    out, out_at = infill.scatter(data, at, a, b, form)
    for i, x in enumerate(blobs):
        lo, hi = a[i] - at[i], b[i] - at[i]
        p, m, s = x[:lo], x[lo:hi], x[hi:]
        want = [x, b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m][form[i]]
        assert out[out_at[i] : out_at[i + 1]].tobytes() == want
    text, text_at = infill.gather(out, out_at, form)
    assert text.tobytes() == data.tobytes() and text_at.tolist() == at.tolist()
