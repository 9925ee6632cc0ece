"""Counts and base score against plain counting; the mixture against a hand-made one."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_tables import prose, table

from tidemark.llm import scoring


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


ROWS = [*[(k, prose(10 + k % 50, k, 40)) for k in range(120)], (500, None), (501, ""), (502, "W1 É w2 w1"), (503, "never seen"), (504, "w1 " * 5000), (505, "w3 w3"), (505, "w3 w3")]


@pytest.mark.parametrize("size", [None, 2000])
def test_scores(spark, monkeypatch, size):
    if size:
        monkeypatch.setattr(scoring, "BLOCK_BYTES", size)
        monkeypatch.setattr(scoring, "BUCKET_BYTES", size)
    part = F.when(F.col("doc_id") % 10 == 3, 0).when(F.col("doc_id") % 10 == 1, 2).otherwise(1)
    seen = {}
    real = scoring.mixture
    monkeypatch.setattr(scoring, "mixture", lambda cells, types: seen.setdefault("w", real(cells, types)))
    got = scoring.score(table(spark, ROWS, ["part", "score", "block"]), part).collect()
    uni, bi, context = Counter(), Counter(), Counter()
    for doc_id, text in ROWS:
        if doc_id % 10 != 3:
            words = tokens(text)
            uni.update(words)
            before = ["<", *words[:-1]]
            context.update(before)
            bi.update(zip(before, words))
    n, types = sum(uni.values()), len(uni)
    want = {}
    for doc_id, text in ROWS:
        words, score = tokens(text), 0.0
        for h, w in zip(["<", *words[:-1]], words):
            c = context[h]
            a, b, e = seen["w"][0 if not c else min(15, 1 + int(math.log2(c)))]
            score += math.log10(a * bi[h, w] / max(1, c) + b * uni[w] / n + e / (types + 1))
        want[doc_id] = (len(words), sum(uni[w] > 0 for w in words), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (types + 1))) for w in words), score)
    assert len(got) == len(ROWS)
    for row in got:
        exact = want[row["id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == exact[:3]
        assert row["base_score"] == pytest.approx(exact[3])
        assert row["score"] == pytest.approx(exact[4])


def test_mixture_prefers_what_explains_held_out_counts():
    cells = np.array([[0, scoring.CELLS - 1, 12, 90], [0, scoring.CELLS - 1, scoring.CELLS - 1, 10], [5, 4, 40, 1000]])
    weights = scoring.mixture(cells, 1000)
    assert weights.sum(1) == pytest.approx(np.ones(scoring.CONTEXTS))
    assert weights[0][0] < 1e-3 and weights[0][1] > 0.8
    assert weights[5][0] > 0.99 and weights[9][0] > 0.99


def test_no_training_and_empty(spark):
    one = scoring.score(table(spark, [(1, "a b"), (2, None)]), F.lit(0)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in sorted(one)] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in one)
    assert scoring.score(table(spark, []), F.lit(1)).count() == 0
