import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from attestor.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = B.read_ranks(PATH)
    return B.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


def check(both, texts):
    codec, library = both
    coded = codec.encode(texts)
    for text, ids, back in zip(texts, coded, codec.decode(coded), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert back == text.encode()


def test_equals_the_library(both):
    rng = random.Random(3)
    check(both, ["", " ", "hello world", "\x00\x01 a", "é" * 300, "x" * 500, "ab" * 400 + "😀" * 100, " " * 1000 + "a", "\n\n\n  b", "don't we'll I'M"])
    check(both, ["".join(rng.choice("ab cdé\n\x00😀0 'stЖ漢") for _ in range(rng.randrange(400))) for _ in range(200)])
    check(both, ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in range(1, 260, 7)])


def test_memory_bound_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 20)
    monkeypatch.setattr(B, "QUERY_BYTES", 50)
    monkeypatch.setattr(B, "DECODE_IDS", 7)
    check(both, [f"some words number {k} and more{k}words" for k in range(60)])


def test_long_piece_equals_recursion(both):
    codec, library = both
    rng = random.Random(5)
    for n in (2, 50, 199):
        piece = "".join(rng.choice("theandinger") for _ in range(n))
        assert B.contract(piece.encode(), codec.ranks) == np.frombuffer(codec.encode([piece])[0], "<u4").tolist()
    long = "".join(rng.choice("theandinger") for _ in range(5000))
    check(both, [long])


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hello hello", "x"), (3, "word " * 50_000, "y"), (3, "word " * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = B.bpe(df, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    by = {r.doc_id: r for r in found}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(found) == 5 and by[1].n_tokens == 0 and by[1].ids_sha256 == empty == by[2].decoded_sha256
    assert by[None].ids == [31373, 23748] and by[3].n_tokens == 50_001
    assert by[3].decoded_sha256 == hashlib.sha256(b"word " * 50_000).hexdigest()
    assert B.bpe(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_wide_vocabularies():
    """Ids beyond 16 bits merge like others; those that the queries cannot hold are refused."""
    base = [(bytes([b]), 300_000 + b) for b in range(256)]
    codec = B.Codec([*base, (b"ab", 65_536 * 3 + 1), (b"abc", 900_000), (b"bc", 900_001)], r"\w+|\W+")
    ids = codec.encode(["abcabx bc"])
    assert list(memoryview(ids[0]).cast("I")) == [900_000, 65_536 * 3 + 1, 300_000 + ord("x"), 300_000 + 32, 900_001]
    assert codec.decode(ids) == [b"abcabx bc"]
    with pytest.raises(ValueError):
        B.Codec([*base, (b"ab", 1 << 20)], r"\w+")
