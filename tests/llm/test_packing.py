"""Packing: ids against the library, whole and gapless sequences, the curve's steps, neighbours along it."""

import itertools
import random
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from text_tables import prose, table
from tokenizers import Tokenizer

from tidemark.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
OPEN = partial(packing.word_coder, PATH)
OPEN_ONE = OPEN()
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, found, sequence):
    """Every id of every row lies in one piece; sequences are gapless and full but for powers of two."""
    got = {}
    for r in found:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        got.setdefault(r["sequence_id"], []).append(r)
    sizes = {}
    for number, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes[number] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == sequence or n <= sequence and n & (n - 1) == 0 for n in sizes.values())
    # pieces in the order of the stream give the documents back
    stream = sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))
    docs, left = [], 0
    for r in stream:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        if r["start"] == 0:
            assert left == 0
            docs.append((str(r["id"]), ids))
            left = r["doc_tokens"] - r["length"]
        else:
            assert docs[-1][0] == str(r["id"]) and r["start"] == len(docs[-1][1])
            docs[-1][1].extend(ids)
            left -= r["length"]
    assert left == 0 and sorted(docs) == sorted((str(r[0]), library(r[1])) for r in rows)
    return [d[0] for d in docs]


@pytest.mark.parametrize("sequence,part", [(2048, 1 << 14), (64, 7), (10, 5)])
def test_whole_and_gapless(spark, monkeypatch, sequence, part):
    monkeypatch.setattr(common, "LEAST_PART", part)
    rows = [(i, prose(i % 40, i % 9)) for i in range(60)] + [(99, prose(3000, 5)), (7, "twice"), (7, "twice"), (None, None), (None, "a"), (61, ""), (62, " \n")]
    docs = table(spark, rows, extra=("ids", "id", "curve", "turn", "part", "n", "before"))
    check(rows, packing.pack(docs, OPEN, sequence=sequence).collect(), sequence)


def test_empty_table_and_single_token(spark):
    assert packing.pack(table(spark, []), OPEN).collect() == []
    one = packing.pack(table(spark, [(1, None)]), OPEN).collect()
    assert [(r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in one] == [(0, 1, 1, 0, 0)]


def test_copies_are_neighbours(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_PART", 16)
    texts = {}
    for k in range(40):
        draw = random.Random(k)
        words = ["".join(draw.choices("aeioubcdfgklmnprst", k=6)) for _ in range(120)]
        texts[k], texts[100 + k] = " ".join(words), " ".join([*words[:110], "changed", *words[111:]])
    hot = {1000 + k: texts[0] for k in range(40)}  # a third of all rows
    rows = list({**texts, **hot}.items())
    order = check(rows, packing.pack(table(spark, rows), OPEN, sequence=256).collect(), 256)
    place = {k: i for i, k in enumerate(order)}
    at = sorted(place[str(k)] for k in hot)
    assert at[-1] - at[0] <= len(hot)
    near = [abs(place[str(k)] - place[str(100 + k)]) for k in range(1, 40)]
    assert np.median(near) <= 6


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(min_codepoint=0x20, max_codepoint=0x260), max_size=60))
def test_latin_words_give_the_library_s_ids(text):
    assert np.frombuffer(OPEN_ONE.ids([text.encode()])[0], OPEN_ONE.kind).tolist() == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBc'sS \t\n\x0b\x1c\x85\xa0  ́éÉßΣς1٣<|>!漢İ😀"), max_size=40))
def test_words_give_the_library_s_ids(text):
    coder = packing.WordCoder(OPEN_ONE.encode, OPEN_ONE.size, 1, OPEN_ONE.plain)
    for _ in range(2):  # the second time from memory
        assert np.frombuffer(coder.ids([text.encode()])[0], coder.kind).tolist() == library(text)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 10)
    monkeypatch.setattr(packing, "CALL_WORDS", 7)
    coder = OPEN()
    for k in range(6):
        texts = [prose(30, k), "<|endoftext|>x " + "long" * 40, prose(30, 0)]
        assert [np.frombuffer(b, coder.kind).tolist() for b in coder.ids([t.encode() for t in texts])] == [library(t) for t in texts]
        assert len(coder.known) <= 10 + 70 and all(len(w) <= packing.KNOWN_BYTES for w in coder.known)


@pytest.mark.parametrize("axes,bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    place = packing.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 2049, 5000, 6144])
def test_rest_is_cut_into_powers_of_two(total):
    starts = packing.starts_of(total, 2048)
    sizes = np.diff(starts).tolist()
    assert starts[0] == total // 2048 * 2048 and starts[-1] == total
    assert all(n & (n - 1) == 0 for n in sizes) and len(set(sizes)) == len(sizes)
