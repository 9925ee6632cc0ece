"""The transducer against tiktoken, the decoder against whole decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from text_tables import table

from tidemark.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_strings_of_tokens():
    draw = random.Random(3)
    tokens = list(RANKS)
    for _ in range(3000):
        text = b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 6))).decode("utf-8", "ignore")
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_pieces_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in ["a" * 5000, "abcabcd" * 700, " \n" * 900, "é漢" * 800, "one two three four five"]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)


@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_incremental_utf8(data, cuts):
    machine, at, out = bpe.Utf8Machine(), 0, ""
    for cut in sorted(cuts) + [len(data)]:
        out += machine.feed(data[at : max(at, cut)])
        at = max(at, cut)
    assert out + machine.close() == data.decode("utf-8", "replace")


def test_table(spark):
    rows = [(1, "The cat sat."), (2, None), (3, ""), (4, "naïve 🙂 text\n\n  end  "), (4, "naïve 🙂 text\n\n  end  "), (None, "<|endoftext|>"), (5, "x y " * 40000)]
    got = bpe.encode_decode(table(spark, rows, ["ids", "id"]), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text in rows:
        whole = np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()
        want[doc_id] = (len(whole) // 4, hashlib.sha256(whole).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    for row in got:
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == want[row["id"]]
        assert len(row["ids"]) == 4 * row["n_tokens"]
    assert bpe.encode_decode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("pair", [(b"a", b"b"), (b"th", b"e")])
def test_merge_bytes(pair):
    assert b"".join(bpe.merge_bytes(RANKS, b"".join(pair))) == b"".join(pair)
