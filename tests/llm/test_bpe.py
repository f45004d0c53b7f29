"""Tokens and decoded texts against the tokenizers library, exactly."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from careerlake.llm import bpe
from tests.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    bits = ["the ", " word", "  ", "\n", "'ll", "'", "<|endoftext|>", "<|endof", "text|>", "é", "日", "12", " 3", ". ",
            "don't ", " ", "a b c d e f ", "𝄞", "\t", "é", "ſ'S "]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    return ["", " ", "a<|endoftext|>b", "x " * 3000 + "<|endoftext|>" + " y" * 3000, "日本語" * 2000, "\n\n  \t" * 1000,
            "don't we'll " * 500, "0123456789 " * 900, "<|endoftext|>" * 300, " a" * 70_000, "z" * 50_000, *made]


def test_whole_texts(library):
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    for text in texts():
        ids = encoder.encode(text.encode())
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert encoder.words.decode(ids) == library.decode(want, skip_special_tokens=False)
    before = encoder.encoded
    for text in texts():
        near = "A start of its own. " + text
        assert encoder.encode(near.encode()).tolist() == library.encode(near, add_special_tokens=False).ids
    assert encoder.encoded - before < 0.8 * before


def test_ids_that_are_no_text_decode_alike(library):
    rng = random.Random(9)
    words = bpe.vocabulary(PATH)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert words.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_repairs_go_on_until_tokens_agree(library, monkeypatch):
    """Anchors where the split does not end a word: every repair must notice and go on."""
    import re

    monkeypatch.setattr(bpe, "_ANCHOR", re.compile(rb"(?<=[a-z])(?=[a-z])"))
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gammadelta"]) for _ in range(3000))
    encoder.encode(text.encode())
    assert encoder.repaired


def test_memory_is_bounded_and_changes_nothing(library):
    encoder = bpe.Encoder(bpe.vocabulary(PATH), kept_bytes=5000)
    rng = random.Random(2)
    for _ in range(30):
        text = " ".join(str(rng.random()) + rng.choice(["abc", "de f"]) for _ in range(400))
        assert encoder.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.held <= 5000


def test_equal_passages_are_cut_alike():
    rng = random.Random(7)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    one = set(bpe._chunks(b"start of one " + passage))
    other = set(bpe._chunks(b"quite another beginning of it " + passage))
    assert len(one & other) >= min(len(one), len(other)) - 2
    assert b"".join(bpe._chunks("é日".encode() * 5000)) == "é日".encode() * 5000
    assert all(c.decode() for c in bpe._chunks("é日".encode() * 5000))


def test_rows(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "a b c " * 900)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "0 AS ids", "'' AS near")
    got = bpe.encoded(both, PATH).collect()
    assert len(got) == both.count()
    by_id = {r.doc_id: r for r in got}
    for row in both.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        mine = by_id[row.doc_id]
        assert mine.ids == ids and mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.encoded(docs.limit(0), PATH).count() == 0
