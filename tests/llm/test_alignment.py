"""Token alignment against a plain walk over byte offsets, on the public vocabularies."""

import hashlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from text_tables import prose, table
from tokenizers import Tokenizer

from tidemark.llm import alignment, common

OPEN_A = partial(alignment.byte_level, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
OPEN_B = partial(alignment.pieces, public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    return OPEN_A(), OPEN_B()


def plain(texts):
    """Ids of both libraries on whole texts, groups by walking, and links by comparing ranges."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = common.byte_characters()
    rows = []
    for text in texts:
        if not text:
            rows.append(([], [], []))
            continue
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        bytes_a = [bytes(names[ch] for ch in tokenizer.id_to_token(i)) for i in a]
        pieces = [model.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = [
            (x, y)
            for x, end_x, one in zip(a, ends_a, bytes_a)
            for y, end_y, other in zip(b, ends_b, bytes_b)
            if max(end_x - len(one), end_y - len(other)) < min(end_x, end_y)
        ]
        rows.append((a, b, groups, links))
    counts = Counter(link for row in rows for link in (row[3] if len(row) > 3 else []))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for row in rows:
        a, b, groups = row[:3]
        links = row[3] if len(row) > 3 else []
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def found(spark, rows, **options):
    got = alignment.align(table(spark, rows, extra=("block", "pair", "pairs", "id", "groups", "of")), OPEN_A, OPEN_B, **options).collect()
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    return sorted((str(r["id"]), *(r[c] for c in columns)) for r in got)


TEXTS = [
    "The unbelievable antidisestablishmentarianism of naïve coöperation, 12345.678!",
    "Größenwahn über die Straße – schöne Grüße aus Köln\n\n\tund 3,50 €",
    "<s>plain</s> <|endoftext|> <unk> text",
    "emoji 😀👩‍👩‍👧 and 漢字 かな",
    "a  b   c \n d\r\n",
    "a▁b",
    " lead and trail ",
    "x" * 3000,
    None,
    "",
    " ",
    "\x00\x01 ﻿",
    "The unbelievable antidisestablishmentarianism of naïve coöperation, 12345.678!",
]


def test_equals_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    texts = [*TEXTS, *(prose(80, seed) for seed in range(8))]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert found(spark, rows) == sorted((str(i), *want) for i, want in enumerate(plain(texts)))


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "some text here"), (1, "some text here"), (1, "some text here"), (None, None)]
    want = plain([t for _, t in rows])
    assert found(spark, rows) == sorted((str(k), *w) for (k, _), w in zip(rows, want))
    assert alignment.align(table(spark, []), OPEN_A, OPEN_B).collect() == []


def test_a_third_of_all_rows_is_one_text(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    rows = [(i, prose(20, i if i % 3 else 0)) for i in range(90)]
    assert found(spark, rows) == sorted((str(i), *want) for (i, _), want in zip(rows, plain([t for _, t in rows])))


def test_parts_of_long_texts_give_the_whole_text_s_tokens(coders, monkeypatch):
    text = " ".join([*TEXTS[:5], prose(300), "a   b  \n c", "d" * 500, "ein ▁ zwei"])
    whole = [coder.encode([text])[0] for coder in coders]
    for size in (1, 7, 40, 333):
        monkeypatch.setattr(alignment, "CALL_CHARS", size)
        assert [alignment._encode(coder, [text, "", text[:9]])[0] for coder in coders] == whole
    assert len(alignment._cut(text)) > 3


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 's\n\t.▁é漢1<|>"), max_size=60))
def test_cut_texts_keep_their_tokens(coders, text):
    if not text:
        return
    whole = [coder.encode([text])[0] for coder in coders]
    kept, alignment.CALL_CHARS = alignment.CALL_CHARS, 3
    try:
        assert [alignment._encode(coder, [text])[0] for coder in coders] == whole
    finally:
        alignment.CALL_CHARS = kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(0, 2**32))
def test_terminals_and_overlaps(lengths, seed):
    end_a = np.cumsum(lengths)
    inner = np.random.default_rng(seed).choice(end_a[-1], size=min(len(lengths), int(end_a[-1])), replace=False)
    end_b = np.unique(np.append(inner[inner > 0], end_a[-1]))
    common = np.intersect1d(end_a, end_b)
    got = alignment.terminals(end_a, end_b)
    want = np.searchsorted(end_b, common[np.searchsorted(common, np.concatenate([end_a, end_b]))])
    assert got.tolist() == want.tolist()
    starts = lambda e: np.concatenate([[0], e[:-1]])
    pairs = [(i, j) for i, (s, e) in enumerate(zip(starts(end_a), end_a)) for j, (t, f) in enumerate(zip(starts(end_b), end_b)) if max(s, t) < min(e, f)]
    assert list(zip(*map(np.ndarray.tolist, alignment.overlaps(end_a, end_b)))) == pairs
