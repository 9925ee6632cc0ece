"""Targets against water filling, the mix against its targets and limits."""

import re
from collections import defaultdict

import pytest
from text_tables import prose, table

from tidemark.llm import mixing

ROWS = [
    *[(k, prose(20 + k % 60, k), "en", "b") for k in range(150)], *[(1000 + k, prose(30, k), "en", "a") for k in range(20)],
    *[(2000 + k, prose(3 + k, k), "en", None) for k in range(5)], (3000, prose(900, 1), "en", "c"), (3001, "", "en", "c"), (3002, None, "en", "d"),
    (3003, "one", "en", "é"), (3003, "one", "en", "é"), (None, "two words", "en", "c"),
]


def water(sizes):
    """Targets by repeated sharing; ``sizes`` by source in order."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    full, total = {}, sum(sizes.values())
    while True:
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: 3.0 * sizes[s] for s in over})


@pytest.mark.parametrize("chunk", [1 << 14, 16])
def test_mix(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 32)
    got = mixing.taken(table(spark, ROWS, ["size", "target", "id"])).collect()
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for _, text, _, source in sorted(ROWS, key=lambda r: (r[3] is None, r[3] or "")):
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = water(sizes)
    taken = defaultdict(int)
    for row in got:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(want[row["source"]])
        if row["id"] != 3003:  # two rows share the words taken under one id
            assert 0 <= row["taken"] <= 3 * row["size"]
            taken[row["source"]] += row["taken"]
    for source, words in taken.items():
        if source != "é":
            assert want[source] - 1 <= words <= want[source] + 1
    again = mixing.taken(table(spark, ROWS)).collect()
    key = lambda r: (str(r["id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_interleaves_in_proportion(spark):
    goal = spark.createDataFrame([("a", 64_000, 64_000.0), ("b", 128_000, 128_000.0), ("c", 192_000, 192_000.0)], "source string, source_size long, target double")
    slots = sorted((r["slot"], r["source"], r["words"]) for r in mixing.schedule(goal, 64).collect())
    assert sum(w for _, _, w in slots) == 384_000
    for n in (60, 600, 3000):
        first = [s for _, s, _ in slots[:n]]
        for source, share in (("a", 1 / 6), ("b", 1 / 3), ("c", 1 / 2)):
            assert abs(first.count(source) - n * share) < 6


def test_mixed_documents(spark):
    docs = table(spark, [r for r in ROWS if r[0] not in (3003, None)], ["__x"])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts, by_id = {r["id"]: r["taken"] for r in mixing.taken(docs).collect()}, defaultdict(list)
    for row in mixed.collect():
        by_id[row["doc_id"]].append(row["text"])
    texts = {r[0]: r[1] for r in ROWS}
    assert {k: sum(len(t.split()) for t in v) for k, v in by_id.items()} == {k: n for k, n in counts.items() if n}
    assert all(re.sub(r"\s+", " ", t) in re.sub(r"\s+", " ", texts[k]) or len(t.split()) < len(texts[k].split()) for k, v in by_id.items() for t in v)


def test_empty(spark):
    assert mixing.taken(table(spark, [])).count() == 0
    assert mixing.mixed_documents(table(spark, [(1, ""), (2, None)])).count() == 0
