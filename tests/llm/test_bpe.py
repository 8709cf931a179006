import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan.llm import bpe
from folioscan.llm.queries import tokenizer_path

TEXTS = ["", " ", "\n\n  \t x", "Hello, world's  best — naïve café 12345 ½ ²", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext", "\u00a0\u2003x\u3000 y\x1c\x1d\x85z", "日本語 テキスト 😀👍🏽", "'S 'll 're'VE", "a" * 3000, "é" * 700, "\x00\x7f\u200b\ufeff", "x" * 129 + " " + "ab" * 64, "\r\n \r\n", "e\u0301 ̈ "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_vocabulary(tokenizer_path()))


def random_texts():
    rng = random.Random(6)
    ranges = [(32, 126), (0, 0x250), (0x300, 0x370), (0x600, 0x6FF), (0x2000, 0x2100), (0x3040, 0x30FF), (0x1F300, 0x1F600), (0x900, 0x980), (0xFE00, 0xFFFD), (0x10000, 0x10FFFF)]
    for _ in range(1500):
        low, high = rng.choice(ranges)
        yield "".join(chr(rng.choice([32, 10, 39, rng.randint(97, 122), rng.randint(low, high)])) for _ in range(rng.randint(1, 60)))


def test_against_the_library(library, encoder):
    for text in [*TEXTS, *random_texts()]:
        ids = list(encoder.encode(text))
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_words_are_merged_alike(encoder):
    rng = random.Random(7)
    for _ in range(200):
        word = bytes(rng.choice(b"etaoinshr\xc3\xa9") for _ in range(rng.randint(1, 200)))
        assert encoder.merge(word) == encoder.merge_long(word)
    assert encoder.merge_long(b"") == []


def test_words_merged_side_by_side(encoder, monkeypatch):
    rng = random.Random(8)
    words = [bytes(rng.choice(b" etaoinshr\xc3\xa9") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for rows in (4096, 7):
        monkeypatch.setattr(bpe, "ROWS", rows)
        assert [np.frombuffer(b, "<i4").tolist() for b in encoder.merge_many(words)] == [encoder.merge(w) for w in words]


def test_texts_cut_at_blanks(library, encoder):
    for text in ("a  b", "a   b ", "a \nb", "a\n b", "a\n\n b", "a\n ", " a", "  ", "a \t", "x\u00a0 y", "x \u00a0y", "it 's I'll", "a <|endoftext|> b"):
        encoder.learn([text])
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_known_words_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    text = " ".join(f"w{i}" for i in range(100))
    assert list(encoder.encode(text)) and len(encoder) <= 10


def test_columns(spark, table, library):
    vocabulary = bpe.load_vocabulary(tokenizer_path())
    texts = [*TEXTS, TEXTS[3], None, "word " * 100_000]
    docs = table([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = docs.select("doc_id", bpe.encode(spark, vocabulary, F.col("text")).alias("ids"))
    found = encoded.select("doc_id", "ids", bpe.decode(spark, vocabulary, F.coalesce("ids", F.array().cast("array<int>"))).alias("text")).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert r.text == text == library.decode(r.ids, skip_special_tokens=False)
    odd = table([([220, None, 10**6, -1],), (None,), ([126, 250],), ([],)], "ids array<int>").select(bpe.decode(spark, vocabulary, F.col("ids"))).collect()
    assert sorted((r[0] for r in odd), key=repr) == sorted([" ", None, library.decode([126, 250], skip_special_tokens=False), ""], key=repr)
    assert table([], "text string").select(bpe.encode(spark, vocabulary, F.col("text"))).collect() == []


def test_batches_are_handed_on_in_slices():
    """A worker holds the ids of a few texts, not of a whole batch."""
    found = [len(part) for part in bpe.slices(iter([pa.array(["a"] * 1200), pa.array([], pa.string()), pa.array(["b"])]))]
    assert found == [500, 500, 200, 1]
