"""The Jaccard join against comparing all pairs."""

import random
import re

import numpy as np
import pytest
from text_tables import prose, table

from tidemark.llm import jaccard

AWKWARD = [
    (900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one TWO"), (905, "one two three four five"), (906, "ONE two three four five"),
    (907, "É one two three four"), (908, "é one two three four"), (909, "same same same same same same"), (909, "same same same same same same"), (910, "one"),
]


def near_rows(seed=1):
    draw = random.Random(seed)
    rows = list(AWKWARD)
    passage = prose(60, 99).split()
    for family in range(12):
        base = prose(draw.choice([12, 40, 150, 300]), family).split()
        for member in range(draw.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            if draw.random() < 0.3:
                words[5:5] = passage
            rows.append((family * 40 + member, " ".join(words)))
    draw.shuffle(rows)
    return rows


def expected(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label):
        least[x] = min(doc_id, least.get(x, doc_id))
    return sorted((doc_id, len(s), least[x]) for (doc_id, _), s, x in zip(rows, sets, label))


@pytest.mark.parametrize("group, rounds", [(256, 2), (3, 1), (1, 1)])
def test_components(spark, monkeypatch, group, rounds):
    """Whatever the leaders find or miss, the index lists complete it."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = near_rows()
    got = jaccard.near_duplicates(table(spark, rows, ["node", "component_id"])).select("id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 5000)
    rows = near_rows(2)
    got = jaccard.near_duplicates(table(spark, rows)).select("id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_lists_skip_no_similar_pair():
    """Every pair the blocks skip fails the bound of sizes and positions."""
    draw = np.random.default_rng(5)
    for block in (64, 4):
        jaccard.LIST_BLOCK = block
        size = draw.integers(20, 60, 300)
        place = draw.integers(0, 15, 300)
        root = draw.integers(0, 40, 300) % 25
        found = {tuple(sorted(p)) for p in jaccard.list_pairs(size, place, root)}
        for i in range(300):
            for j in range(i):
                need = -(-75 * (size[i] + size[j]) // 175)
                fits = 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j]) and min(size[i] - place[i], size[j] - place[j]) >= need
                assert ((j, i) in found) == (fits and root[i] != root[j])
    jaccard.LIST_BLOCK = 64


def test_stage_and_empty(spark):
    rows = near_rows()
    docs = table(spark, rows, ["node"])
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {component for _, _, component in expected(rows)}
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y")], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["component"]) for r in jaccard.components(edges).collect()}
    assert all(got[bytes([i])] == bytes([0]) for i in range(41)) and got[b"y"] == b"x"
