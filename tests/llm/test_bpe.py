"""Encoding equals the reference tokenizer's library and decodes to the same bytes."""

import array
import base64
import random

import cases
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidewell.llm import bpe

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "=", "-", " ", "  ", "\n", "\n\n", "'s", "'", "é", "漢", "\u0085", "\x1c", "\t", "1", "12", ".", ",", "aaaa", "----", "　", "😀", "the", " ing", "\r\n", "ñ", "\xa0", "A", "<|endoftext|>"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_bytes(ids):
    return array.array("I", ids).tobytes()


def test_fuzz_against_tiktoken(plain):
    codec, rng = bpe.codec(RANKS, P.PATTERN), random.Random(1)
    for i in range(6000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) if i % 3 else rng.choice("=-#*! \nae.") * rng.randint(1, 200)
        ids = codec.encode(text)
        assert ids == as_bytes(plain.encode_ordinary(text)), repr(text)
        assert codec.decode(ids) == text.encode()


def test_fuzz_against_tokenizers():
    codec, rng, whole = bpe.codec(JSON), random.Random(2), Tokenizer.from_file(JSON)
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        assert codec.encode(text) == as_bytes(whole.encode(text, add_special_tokens=False).ids), repr(text)


def test_split_characters_decode(plain):
    codec = bpe.codec(RANKS, P.PATTERN)
    ids = codec.encode("漢字😀")
    assert b"".join(codec.decode(ids[i : i + 4]) for i in range(0, len(ids), 4)) == "漢字😀".encode()


def test_tables(spark, plain):
    encoded = bpe.encode(cases.edges(spark), RANKS, P.PATTERN, offsets=True)
    rows = bpe.decode(encoded, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id, r.text or "", r.score or "") for r in rows) == sorted((a, b or "", c or "") for a, b, c in cases.EDGES)
    for r in rows:
        text = r.text or ""
        assert bytes(r.ids) == as_bytes(plain.encode_ordinary(text)) and r.n_tokens == len(r.ids) // 4 == len(r.starts) == len(r.ends)
        assert bytes(r.decoded) == text.encode()
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends))
    assert bpe.decode(bpe.encode(cases.empty(spark), RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
