"""Merkle manifest against a plain tree, for whole and ragged trees, other fanouts and awkward rows."""

import hashlib

import pytest
from pyspark.sql import functions as F
from text_tables import table

from tidemark.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    shown = [None if row[f] is None else str(row[f]) for f in manifest.FIELDS]
    return h(*["-" if s is None else f"{len(s.encode())}:{s}" for s in shown])


def climb(nodes, fanout):
    """Root of the nodes and, for each, its siblings level by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            low = i - i % fanout
            proofs[k].append(("".join(level[low:i]), "".join(level[i + 1 : low + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], proofs


def brute(rows, fanout):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = []
    for name in names:
        mine = sorted(trees[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        built.append((mine, *climb([plain_leaf(r) for r in mine], fanout)))
    root, tops = climb([b[1] for b in built], fanout)
    return sorted(
        (str(r["doc_id"]), plain_leaf(r), sub, root, tuple(proof + top))
        for (mine, sub, proofs), top in zip(built, tops)
        for r, proof in zip(mine, proofs)
    )


def shown(found):
    return sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"])) for r in found.collect())


def sample(spark, n):
    rows = [(i * 7 % 1000, f"text {i} ä", ["en", "de", None, "", "zh-é"][min(4, i % 11)], f"s{i % 3}") for i in range(n)]
    return table(spark, rows)


@pytest.mark.parametrize("n,fanout,block", [(1, 2, 4), (2, 2, 4), (5, 2, 2), (103, 2, 4), (103, 3, 3), (97, 4, 16), (130, 2, 4096)])
def test_equals_plain_tree(spark, monkeypatch, n, fanout, block):
    monkeypatch.setattr(manifest, "BLOCK_LEAVES", block)
    docs = sample(spark, n)
    assert shown(manifest.manifest(docs, fanout=fanout)) == brute(docs.collect(), fanout)


def test_state_is_written_between_rounds(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_LEAVES", 2)
    monkeypatch.setattr(manifest, "ROUNDS", 2)
    docs = sample(spark, 90)
    assert shown(manifest.manifest(docs)) == brute(docs.collect(), 2)


def test_one_tree_holds_a_third_of_all_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_LEAVES", 8)
    docs = table(spark, [(5, "same")] * 60 + [(i, f"t{i}", "de" if i % 2 else "en", "s") for i in range(120)])
    assert shown(manifest.manifest(docs)) == brute(docs.collect(), 2)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_LEAVES", 2)
    rows = [(None, None, None, None), (None, "a"), (1, ""), (1, None), (2, "x" * 200_000), (2, "x" * 200_000), (3, "1:a", None, "-"), (4, "é\n\x00", "en", None)]
    docs = table(spark, rows, extra=("leaf", "tree", "id", "block", "node", "proof", "position", "part", "turn", "root"))
    assert shown(manifest.manifest(docs)) == brute(docs.collect(), 2)
    assert manifest.manifest(docs.limit(0)).collect() == []


def test_without_trees_and_with_carried_columns(spark):
    docs = sample(spark, 20)
    found = manifest.manifest(docs, by=None, carried={"leaf_source": F.col("source")}).collect()
    assert len({(r["subroot"], r["root"]) for r in found}) == 1 and found[0]["root"] == found[0]["subroot"]
    assert {r["leaf_source"] for r in found} == {"s0", "s1", "s2"}
    with pytest.raises(ValueError, match="fanout"):
        manifest.manifest(docs, fanout=1)


def test_folding_finds_what_was_changed(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_LEAVES", 4)
    found = manifest.manifest(sample(spark, 50))
    wrong = F.concat(F.lit("g"), F.substring("leaf", 2, 63))
    got = found.select("root", "proof", manifest.folded(F.col("leaf"), F.col("proof")).alias("kept"), manifest.folded(wrong, F.col("proof")).alias("lost"), manifest.proof_digest(F.col("proof")).alias("digest")).collect()
    assert all(r["kept"] == r["root"] and r["lost"] != r["root"] for r in got)
    assert all(r["digest"] == h(*[s for step in r["proof"] for s in (step["left"], step["right"])]) for r in got)
