"""Merkle manifest of a dataset by a butterfly exchange.

Every row is hashed to a leaf. The leaves of one tree ascend by id and are cut into
aligned blocks of ``fanout ** levels``; a block hashes its own subtree. Then the blocks
swap subtree roots round by round: in round r the ``fanout`` blocks whose numbers
differ in digit r alone meet, and each of them hashes the parent for itself and keeps
the siblings. After as many rounds as block numbers have digits every block holds the
root and all upper siblings of its leaves; nothing is sent down again. Trees are nodes
of one more tree, over which the same exchange runs.

Numbers up to the next power of the fanout that no block has are taken by ghosts
without a node: they carry on what their group hands them, so that every block finds
a partner in every round. At most ``fanout`` times the blocks take part, one small
row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as c
from tidemark.session import materialize

#: Leaves of a block, at most.
BLOCK_LEAVES = 4096
#: Rounds of the exchange between two writes of its state.
ROUNDS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field by its length in bytes and its value, ``-`` where it is null."""
    shown = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]))


def _parents(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def _levels(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """Nodes of every level: ``levels`` steps up, or up to a single node."""
    out = [nodes]
    while len(out) - 1 < levels if levels is not None else len(out[-1]) > 1:
        out.append(_parents(out[-1], fanout))
    return out


def _subtree(rows: pa.Table, fanout: int, levels: int) -> list[list[str]]:
    # a tree of one block ends at its root; any other block goes up all its levels
    alone = rows["blocks"][0].as_py() == 1
    return _levels(rows["leaf"].to_pylist(), fanout, None if alone else levels)


def _block_root(fanout: int, levels: int):
    def root(key: tuple, rows: pa.Table) -> pa.Table:
        node = _subtree(rows.sort_by("position"), fanout, levels)[-1][0]
        return pa.table({"tree": rows["tree"][:1], "block": rows["block"][:1], "node": [node]})

    return root


def exchange(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, node, proof) of every block of (tree, block, node): its tree's root and the siblings on the way.

    Blocks of a tree are numbered from 0 without gaps. Each round is one shuffle of one
    small row a block, by the number without digit r.
    """
    counts = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("blocks"))
    largest = counts.agg(F.max("blocks")).first()[0] or 0
    most = 0
    while fanout**most < largest:
        most += 1
    rounds = sum((F.when(F.col("blocks") > fanout**r, 1).otherwise(0) for r in range(most)), F.lit(0))
    sized = counts.withColumn("rounds", rounds).withColumn("width", F.element_at(F.array(*[F.lit(fanout**r) for r in range(most + 1)]), F.col("rounds") + 1))
    ghost = sized.where("width > blocks").select("tree", F.explode(F.expr("sequence(blocks, width - 1)")).alias("block"), F.lit(None).cast("string").alias("node"))
    state = nodes.select("tree", F.col("block").cast("long").alias("block"), "node").unionByName(ghost)
    state = state.join(sized.select("tree", "blocks", "rounds"), "tree").withColumn("proof", F.expr(f"cast(array() as {PROOF})"))
    for r in range(most):
        state = state.withColumn("digit", F.expr(f"block div {fanout**r} % {fanout}"))
        state = state.withColumn("group", F.col("block") - F.col("digit") * fanout**r)
        met = F.sort_array(F.collect_list(F.struct("digit", "node")).over(Window.partitionBy("tree", "group")))
        state = state.withColumn("met", met)

        def joined(keep, met=F.col("met")) -> Column:
            return F.array_join(F.transform(F.filter(met, keep), lambda m: m["node"]), "")

        step = F.struct(joined(lambda m: m["digit"] < F.col("digit")).alias("left"), joined(lambda m: m["digit"] > F.col("digit")).alias("right"))
        some = joined(lambda m: m["node"].isNotNull())
        going = F.col("rounds") > r
        state = state.withColumn("proof", F.when(going, F.concat("proof", F.array(step))).otherwise(F.col("proof")))
        state = state.withColumn("node", F.when(going, F.when(some != "", digest(some))).otherwise(F.col("node"))).drop("digit", "group", "met")
        if (r + 1) % ROUNDS == 0:
            state = materialize(state)
    return state.where("block < blocks").select("tree", "block", "node", "proof")


def _sides(nodes: list[str], fanout: int) -> tuple[list[str], list[str]]:
    """For every node its siblings to the left and to the right, joined."""
    left = ["".join(nodes[i - i % fanout : i]) for i in range(len(nodes))]
    right = ["".join(nodes[i + 1 : i - i % fanout + fanout]) for i in range(len(nodes))]
    return left, right


def _prove(fanout: int, levels: int, shown: list[str]):
    def prove(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("position").combine_chunks()
        tree = _subtree(rows, fanout, levels)
        n = rows.num_rows
        sides, index, base = ([], []), [], 0
        for level, nodes in enumerate(tree[:-1]):
            for side, more in zip(sides, _sides(nodes, fanout)):
                side.extend(more)
            index.append(base + np.arange(n) // fanout**level)
            base += len(nodes)
        for step in above["proof"][0].as_py():
            sides[0].append(step["left"])
            sides[1].append(step["right"])
            index.append(np.full(n, base))
            base += 1
        at = pa.array(np.stack(index, 1).ravel() if index else np.zeros(0, np.int64), pa.int64())
        steps = pa.StructArray.from_arrays([pa.array(s, pa.string()).take(at) for s in sides], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(index), pa.int32()), steps)
        fixed = {name: pa.array([above[name][0].as_py()] * n, pa.string()) for name in ("subroot", "root")}
        return pa.table({**{name: rows[name] for name in shown}, **fixed, "proof": proof})

    return prove


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    by: str | None = "lang",
    fields: Sequence[str] = FIELDS,
    carried: Mapping[str, Column] | None = None,
    fanout: int = 2,
) -> DataFrame:
    """(id, leaf, subroot, root, proof) of every row, with the ``carried`` columns.

    ``proof`` has one step a level from the leaf to the root over all trees: the
    siblings' digests left and right of the row's own node, joined; a node without
    siblings has an empty step. A tree is one value of ``by`` (null is a value of its
    own and comes first); without ``by`` there is one tree. Null ids come first, equal
    ids go by their leaf, so that rows repeated in full are neighbours and each has a
    leaf. Null fields count as ``-``, empty texts as ``0:``. An empty table gives an
    empty result. Columns that are not named here are not read, whatever their names.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    c.free_shuffles(docs.sparkSession)
    levels = 1
    while fanout ** (levels + 1) <= BLOCK_LEAVES:
        levels += 1
    carried = dict(carried or {})
    # null sorts before "=" and any text behind it
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    rows = docs.select(tree.alias("tree"), F.col(key).alias("id"), leaf([F.col(f) for f in fields]).alias("leaf"), *[v.alias(f"carried_{k}") for k, v in carried.items()])
    rows = materialize(rows.withColumn("turn", F.monotonically_increasing_id()))
    placed = c.ordered(rows, ["tree", "id", "leaf", "turn"])
    # one row a part and tree; the window below runs over the parts of one tree
    spans = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("n").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    width = fanout**levels
    starts = spans.select("tree", "part", (ahead - F.col("first")).alias("shift"), F.ceil(F.sum("n").over(parts) / width).alias("blocks"))
    leaves = placed.join(starts, ["tree", "part"]).withColumn("position", F.col("place") + F.col("shift"))
    leaves = leaves.withColumn("block", F.expr(f"position div {width}")).drop("part", "place", "shift", "turn")
    roots = materialize(leaves.select("tree", "block", "blocks", "position", "leaf").groupBy("tree", "block").applyInArrow(_block_root(fanout, levels), "tree string, block long, node string"))
    within = materialize(exchange(roots, fanout))
    # the trees are few; still they are ordered like any rows, without a window over all
    subroots = c.ordered(within.where("block = 0").select(F.col("tree").alias("of"), "node"), ["of"])
    sizes = subroots.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    named = materialize(subroots.join(earlier, "part").select("of", "node", (F.col("place") + F.col("shift")).alias("block")))
    top = exchange(named.select(F.lit("").alias("tree"), "block", "node"), fanout)
    top = named.select("of", "block").join(top.select("block", F.col("node").alias("root"), F.col("proof").alias("more")), "block").drop("block")
    above = within.join(top, F.col("tree") == F.col("of")).select("tree", "block", F.col("node").alias("subroot"), "root", F.concat("proof", "more").alias("proof"))
    shown = ["id", "leaf", *[f"carried_{k}" for k in carried]]
    kind = {f.name: f.dataType.simpleString() for f in leaves.schema}
    schema = ", ".join([*[f"{name} {kind[name]}" for name in shown], "subroot string", "root string", f"proof {PROOF}"])
    found = leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_prove(fanout, levels, shown), schema)
    return found.select("id", *[F.col(f"carried_{k}").alias(k) for k in carried], "leaf", "subroot", "root", "proof")


def folded(node: Column, proof: Column) -> Column:
    """Root that ``node`` leads to along ``proof``."""
    return F.aggregate(proof, node, lambda at, step: digest(F.concat(step["left"], at, step["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))
