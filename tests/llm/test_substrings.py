"""Passage removal against a table of windows; the automaton against plain search."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from text_tables import prose, table

from tidemark.llm import substrings


def expected(rows):
    seen, out = {}, {}
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text)
    for doc_id in sorted(texts, key=lambda x: (x is not None, x or 0)):
        own = []
        for text in texts[doc_id]:
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            gone = [False] * len(words)
            for k in range(len(words) - 12):
                window = tuple(words[k : k + 13])
                if window in seen:
                    gone[k : k + 13] = [True] * 13
                own.append(window)
            out.setdefault(doc_id, []).append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
        seen.update(dict.fromkeys(own))
    return sorted(((doc_id, *x) for doc_id, some in out.items() for x in some), key=str)


def rows(seed=4):
    draw = random.Random(seed)
    passages = [prose(draw.choice([12, 13, 14, 40]), 1000 + k) for k in range(6)]
    made = [(-1, None), (-2, ""), (-3, "short"), (None, passages[0] + " " + passages[1]), (7000, "a " * 40), (7001, "a " * 60), (7001, "a " * 60)]
    for k in range(80):
        parts = [prose(draw.randint(0, 50), k), draw.choice(passages), prose(draw.randint(0, 9), k + 500), draw.choice(passages), draw.choice(["", "\n\té x"])]
        made.append((draw.randrange(10_000), " ".join(parts)))
    made += [(20_000 + k, made[20][1]) for k in range(15)]
    return made


@pytest.mark.parametrize("size", [None, 3000])
def test_removal(spark, monkeypatch, size):
    if size:
        for name in ("BLOCK_BYTES", "BUCKET_BYTES", "SHARD_BYTES"):
            monkeypatch.setattr(substrings, name, size)
    some = rows()
    got = substrings.remove_repeats(table(spark, some, ["kept", "block", "id"])).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == expected(some)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_empty(spark):
    assert substrings.remove_repeats(table(spark, [])).count() == 0


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=8), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_automaton(strings, window):
    automaton, added = substrings.SuffixAutomaton(), []
    for document, words in enumerate(strings):
        windows = [tuple(words[k : k + window]) for k in range(len(words) - window + 1)]
        want = [next((d for d, other in added if any(tuple(other[k : k + window]) == w for k in range(len(other)))), None) for w in windows]
        assert automaton.origins(words, window) == want
        automaton.add(words, document)
        added.append((document, words))
