"""Exact dedup against plain grouping, also when every digest is or isn't frequent."""

import hashlib
import re

import pytest
from text_tables import table

from tidemark.llm import exact_dedup

ROWS = [
    (5, "a b c"), (3, "ab\tc"), (9, "a  b  c"), (4, "other"), (6, None), (7, ""), (8, " \n"), (1, "tie x"), (2, "t iex"), (2, "t iex"),
    (None, "no id"), (10, "no\xa0id"), (11, "　wide"), *[(100 + i, "copy  " + " " * (i % 3)) for i in range(40)],
]


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    out = []
    for doc_id, text in rows:
        mark = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[mark], key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out.append((doc_id, hashlib.sha256(mark.encode()).hexdigest(), best[1], len(groups[mark])))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [1, 256])
def test_groups(spark, monkeypatch, frequent):
    monkeypatch.setattr(exact_dedup, "FREQUENT", frequent)
    got = exact_dedup.exact_groups(table(spark, ROWS, ["digest", "keep_id", "id"])).select("id", "digest", "keep_id", "group_size").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    docs = table(spark, ROWS, ["digest", "length"])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    best = {(x[2], x[1]) for x in expected(ROWS)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(doc_id) for doc_id, _ in best)


def test_drop_copies_carries_columns_named_like_its_own(spark):
    rows = [(1, "a b", "x", 7), (1, "a  b", "y", 8), (1, "a  b", "y", 8), (2, "ab", "z", 9), (None, "c", "n", 1), (None, "c", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, turn int")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a  b", "y", 8), (None, "c", "n", 1)]


def test_empty(spark):
    docs = table(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0
