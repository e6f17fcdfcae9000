"""BPE against the tokenizer library and as an exact round trip."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quire.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, begin, counts = bpe.codec(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), at)
    cut = np.cumsum(counts)[:-1]
    return [x.tolist() for x in np.split(ids, cut)], [x.tolist() for x in np.split(begin, cut)]


def test_random_texts(library):
    rng = random.Random(5)
    alphabet = [*"aestmdrvl'\"  \t\n.,!12é", "'s", "'re", "'ll", "'ve", "  ", "\r\n", "Ж", "你", "　", " ", "🙂", "Ⅷ", "<|endoftext|>"]
    alphabet += [chr(c) for pair in (*bpe.LETTERS_16, *bpe.NUMBERS_16) for c in pair]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)] + ["", "'", "'r", "'l", "a'", " ", "  a "]
    ids, begin = _encode(texts)
    for text, got, at in zip(texts, ids, begin, strict=True):
        assert got == library.encode_ordinary(text), repr(text)
        assert at == np.cumsum([0, *[len(library.decode_single_token_bytes(i)) for i in got]])[:-1].tolist()
        assert bpe.codec(PATH).decode(np.array(got, dtype=np.int64)).tobytes() == text.encode()


def test_every_code_point(library):
    text = "".join(chr(c) + ("x" if c % 3 else " ") for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert _encode([text])[0][0] == library.encode_ordinary(text)


def test_long_slices(library):
    rng = random.Random(2)
    texts = ["a" * 5000, "".join(rng.choices("abcdefgh", k=20000)), "!" * 3001, " " * 2000 + "x", "é" * 900]
    assert _encode(texts)[0] == [library.encode_ordinary(t) for t in texts]


def test_frames(spark, library):
    rows = [(1, "It's here, they'll see.\n\n  ok", 3), (None, None, 4), (2, "", 5), (2, "x " * 300, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r["text"]) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    for r in bpe.round_trip(docs.where("doc_id = 1"), PATH).collect():
        ids = library.encode_ordinary(rows[0][1])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert bpe.round_trip(docs, PATH).count() == 4
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
