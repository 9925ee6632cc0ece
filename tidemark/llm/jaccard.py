"""Exact Jaccard self-join of word-shingle sets that skips by relations between sets.

1. *Rarity.* Blocks of documents ask for the number of documents with each of
   their shingles. Only texts whose shared shingles could make up the required
   part of their set go on, with these shingles in order of rarity.
2. *Classes.* Equal sets become one node.
3. *Answers of a similar set.* Nodes that agree in a minimum hash meet in small groups,
   where each is compared with the group's leaders. A node found similar follows
   its leader: whatever links to it links to the leader's component, so its answers
   are the leader's and only links across components are looked for.
4. *Index lists.* Each node enters the lists of the rarest shingles of which two
   similar sets must share one. Lists are cut into blocks with the bounds of their
   sizes and positions; blocks that can't reach the required overlap, or that hold
   only sets of the probing set's component, are skipped whole.
5. Pairs found are compared in full and linked components are merged. First the lists
   are probed with a few sets of each component only, which joins the parts of
   large groups at the price of few pairs; the last probe takes all sets.

No pair within a component is emitted, and no link between components is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c
from tidemark.session import materialize

WORDS = 5
#: Similarity as a fraction of whole numbers: LEAST_PART * union <= LEAST_WHOLE * intersection.
LEAST_PART, LEAST_WHOLE = 75, 100
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
#: Nodes compared in one group of step 3; larger groups are split by a hash.
GROUP = 256
ROUNDS = 3
#: Probes with ``PICKS`` sets of each component in a list before the one with all sets.
SPARSE_ROUNDS = 2
PICKS = 3
#: Entries of an index list skipped together.
LIST_BLOCK = 64
#: Postings a list bucket aims at.
BUCKET_POSTINGS = 1 << 20


def _sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within the text, and where each text's begin."""
    words, first = c.word_hashes(*c.text_buffer(texts), fold=True)
    runs = c.window_hashes(words, WORDS)
    out, sizes = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= WORDS:
            own = np.unique(runs[a : b - WORDS + 1])
        elif b > a:
            own = np.array([c.run_hash(words[a:b])], np.uint64)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def _ask(buckets: int):
    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        shingles, _ = _sets(rows["text"])
        known, counts = np.unique(shingles, return_counts=True)
        out = [(bucket, c.pack(c.short(rest, 5), c.narrow(counts[at]))) for bucket, at, rest in c.split_keys(known, buckets)]
        block = rows["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(out), pa.int32()), "bucket": pa.array([b for b, _ in out], pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})

    return ask


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """Rarity class of each asked shingle: 0 for one document, else about 8 * log2 of their number."""
    asked = [c.unpack(p) for p in rows["payload"].to_pylist()]
    known, at = np.unique(np.concatenate([c.long(keys) for keys, _ in asked]), return_inverse=True)
    count = np.bincount(at, np.concatenate([n for _, n in asked]).astype(float), len(known))
    rarity = np.where(count > 1, np.minimum(255, np.floor(8 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)[at]
    ends = np.cumsum([len(keys) for keys, _ in asked])
    parts = np.split(rarity, ends[:-1])
    return pa.table({"block": rows["block"].cast(pa.int32()), "bucket": rows["bucket"].cast(pa.int32()), "payload": pa.array([x.tobytes() for x in parts], pa.binary())})


def _shared(buckets: int):
    def shared(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        shingles, first = _sets(docs["text"])
        known, at = np.unique(shingles, return_inverse=True)
        rarity = np.zeros(len(known), np.uint8)
        got = dict(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()))
        for bucket, places, _ in c.split_keys(known, buckets):
            rarity[places] = np.frombuffer(got[bucket], np.uint8)
        rarity = rarity[at]
        marks, sets = [], []
        for a, b in zip(first[:-1], first[1:]):
            often = rarity[a:b] > 0
            if b == a or LEAST_WHOLE * int(often.sum()) < LEAST_PART * int(b - a):
                marks.append(None)
                sets.append(None)
                continue
            own, rank = shingles[a:b][often], rarity[a:b][often]
            marks.append(hashlib.blake2b(shingles[a:b].tobytes(), digest_size=16).digest())
            sets.append(own[np.lexsort((own, rank))].tobytes())
        return pa.table({"id": docs["id"], "n": pa.array(np.diff(first)), "node": pa.array(marks, pa.binary()), "shared": pa.array(sets, pa.binary())})

    return shared


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, node, shared): size of every set; for those with possible partners, their class and shared shingles."""
    c.free_shuffles(docs.sparkSession)
    total = c.text_bytes(docs, text)
    buckets = max(1, -(-total // BUCKET_BYTES))
    blocks = c.blocks_of(docs, key, text, total, BLOCK_BYTES)
    asked = blocks.groupBy("block").applyInArrow(_ask(buckets), "block int, bucket int, payload binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, payload binary")
    kind = blocks.schema["id"].dataType.simpleString()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_shared(buckets), f"id {kind}, n long, node binary, shared binary")


def _similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST_WHOLE * both >= LEAST_PART * (n_a + n_b - both)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _follow(key: tuple, rows: pa.Table) -> pa.Table:
    """(node, leader): each node of a group follows the first leader similar to it, or leads."""
    nodes, sizes, sets = rows["node"].to_pylist(), rows["n"].to_pylist(), [_set(x) for x in rows["shared"].to_pylist()]
    leaders: list[int] = []
    follows = []
    for i in sorted(range(len(nodes)), key=nodes.__getitem__):
        for k in leaders:
            small, large = sorted((sizes[i], sizes[k]))
            if LEAST_WHOLE * small >= LEAST_PART * large and _similar(sets[i], sizes[i], sets[k], sizes[k]):
                follows.append((nodes[i], nodes[k]))
                break
        else:
            leaders.append(i)
    return pa.table({"node": pa.array([a for a, _ in follows], pa.binary()), "leader": pa.array([b for _, b in follows], pa.binary())})


def _minimum(seed: int):
    salt = np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64)

    def minimum(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                least = [int(c.mix(_set(x) ^ salt).min() >> np.uint64(1)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["node", "n", "shared", "meet"])

    return minimum


def leaders(nodes: DataFrame) -> DataFrame:
    """(node, root): the node whose component each node belongs to by step 3; most are their own."""
    roots = nodes.select("node", F.col("node").alias("root"))
    left = nodes
    for seed in range(ROUNDS):
        met = left.select("node", "n", "shared").mapInArrow(_minimum(seed), "node binary, n long, shared binary, meet long")
        met = materialize(met)
        counts = met.groupBy("meet").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        parts = F.ceil(F.col("size") / GROUP)
        grouped = met.join(counts, "meet").withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), parts))
        # dealt by both: the join's partitioning by meet alone would leave all parts of a large group in one task
        dealt = grouped.select("meet", "part", "node", "n", "shared").repartition("meet", "part")
        follows = materialize(dealt.groupBy("meet", "part").applyInArrow(_follow, "node binary, leader binary"))
        step = follows.select(F.col("node").alias("root"), "leader")
        roots = materialize(roots.join(step, "root", "left").select("node", F.coalesce("leader", "root").alias("root")))
        left = left.join(follows.select("node"), "node", "left_anti")
    return roots


def _post(buckets: int):
    def post(batches):
        for batch in batches:
            marks, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sets, roots = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            tokens, owner, place = [], [], []
            for i, data in enumerate(sets):
                own, n = _set(data), int(sizes[i])
                single = n - len(own)  # shingles of this text alone are the rarest
                last = n - -(-LEAST_PART * n // LEAST_WHOLE) + 1
                some = own[: max(0, last - single)]
                tokens.append(some)
                owner.append(np.full(len(some), i))
                place.append(np.arange(single, single + len(some)))
            if not tokens:
                continue
            tokens, owner, place = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place)
            out = []
            for bucket, at, rest in c.split_keys(tokens, buckets):
                who, local = np.unique(owner[at], return_inverse=True)
                out.append((bucket, c.pack(rest, local, place[at], sizes[who], np.array([marks[k] for k in who], object), np.array([roots[k] for k in who], object))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], ["bucket", "payload"])

    return post


def list_pairs(size: np.ndarray, place: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of one index list's entries, of different components, that could be similar.

    Entries go by component, components by their number of entries, so that the largest is only probed.
    """
    names, part, counts = np.unique(root, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    order = np.lexsort((place, size, part, counts[part]))
    size, place, part = size[order], place[order], part[order]
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
    cuts = np.arange(0, len(part), LIST_BLOCK)
    low, high = np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts)
    rest = np.maximum.reduceat(size - place, cuts)
    found = []
    for i in range(len(part)):
        begin = int(ends[np.searchsorted(ends, i, "right")])
        if begin == len(part):
            break
        n = int(size[i])
        # overlap needed with a set of size m: LEAST_PART (n + m) / (LEAST_PART + LEAST_WHOLE)
        need = lambda m: -(-LEAST_PART * (n + m) // (LEAST_PART + LEAST_WHOLE))
        b = begin // LIST_BLOCK
        alive = (LEAST_WHOLE * high[b:] >= LEAST_PART * n) & (LEAST_PART * low[b:] <= LEAST_WHOLE * n) & (np.minimum(n - place[i], rest[b:]) >= need(low[b:]))
        for block in b + np.flatnonzero(alive):
            at = np.arange(max(begin, int(cuts[block])), min(len(part), int(cuts[block]) + LIST_BLOCK))
            m = size[at]
            fits = (LEAST_WHOLE * m >= LEAST_PART * n) & (LEAST_PART * m <= LEAST_WHOLE * n) & (np.minimum(n - place[i], m - place[at]) >= need(m))
            found.extend((int(order[i]), int(order[j])) for j in at[fits])
    return found


def _picked(token: np.ndarray, who: np.ndarray, root: np.ndarray, turn: int) -> np.ndarray:
    """Places of at most ``PICKS`` entries of each component in each list, others in every list and turn."""
    with np.errstate(over="ignore"):
        draw = c.mix(token * np.uint64(0x9E3779B97F4A7C15) + who.astype(np.uint64) + np.uint64(turn << 40))
    order = np.lexsort((draw, root, token))
    new = np.append(True, (token[order][1:] != token[order][:-1]) | (root[order][1:] != root[order][:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - begin < PICKS])


def _probe(turn: int | None):
    """Pairs of a bucket of lists; ``turn`` numbers a sparse probe, None is the probe with all sets."""

    def probe(key: tuple, rows: pa.Table) -> pa.Table:
        return _probe_lists(rows, turn)

    return probe


def _probe_lists(rows: pa.Table, turn: int | None) -> pa.Table:
    parts = [c.unpack(p) for p in rows["payload"].to_pylist()]
    base = np.cumsum([0] + [len(p[4]) for p in parts])
    token = np.concatenate([p[0] for p in parts])
    who = np.concatenate([p[1] + base[i] for i, p in enumerate(parts)])
    place = np.concatenate([p[2] for p in parts])
    sizes, marks, roots = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
    _, root = np.unique(roots, return_inverse=True)
    if turn is not None:
        some = _picked(token, who, root[who], turn)
        token, who, place = token[some], who[some], place[some]
    order = np.argsort(token, kind="stable")
    token, who, place = token[order], who[order], place[order]
    edges = np.append(np.append(0, np.flatnonzero(np.diff(token)) + 1), len(token))
    pairs = set()
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            own = who[a:b]
            for i, j in list_pairs(sizes[own], place[a:b], root[own]):
                x, y = marks[own[i]], marks[own[j]]
                pairs.add((x, y) if x < y else (y, x))
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})


def _verify(batches):
    for batch in batches:
        a, b, n_a, n_b, s_a, s_b = (batch.column(k).to_pylist() for k in range(6))
        same = [i for i in range(len(a)) if _similar(_set(s_a[i]), n_a[i], _set(s_b[i]), n_b[i])]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in same], pa.binary()), pa.array([b[i] for i in same], pa.binary())], ["a", "b"])


def cross_links(nodes: DataFrame, roots: DataFrame, turn: int | None = None) -> DataFrame:
    """(a, b): similar nodes of different components; with ``turn`` only some of them."""
    postings = int(nodes.agg(F.sum(F.octet_length("shared")).alias("n")).first()["n"] or 0) // 8 // 4
    buckets = max(16, -(-postings // BUCKET_POSTINGS))
    rows = nodes.join(roots, "node").select("node", "n", "shared", "root")
    lists = rows.mapInArrow(_post(buckets), "bucket int, payload binary")
    pairs = lists.groupBy("bucket").applyInArrow(_probe(turn), "a binary, b binary").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return full.mapInArrow(_verify, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the end points of ``edges`` (a, b): the smallest node each can reach.

    Labels go down to the smallest neighbour's, then to their label's label, until
    none changes; every step is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("other"))
        lower = labels.join(near, "node").select("node", F.least("component", "other").alias("component"), F.col("component").alias("was"))
        lower = materialize(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = materialize(lower.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component"), "was"))
        if new.where("component <> was").isEmpty():
            return labels
        labels = new.select("node", "component")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after linked components became one."""
    end = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    edges = links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    found = components(edges).select(F.col("node").alias("root"), "component")
    return materialize(roots.join(found, "root", "left").select("node", F.coalesce("component", "root").alias("root")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    A text's set holds its distinct runs of five words (A-Z as a-z); a shorter text
    is one run; a null, empty or blank one has no shingles and no links. Equal sets
    link. Repeated rows are members of the same component. component_id is the smallest id
    that links lead to. Shingles are compared by 64-bit hashes. An empty table gives
    an empty result.
    """
    sets = materialize(shingle_sets(docs, key, text))
    some = sets.where("node is not null")
    nodes = materialize(some.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("shared").alias("shared")))
    few = nodes.select("node", "n", "shared")
    roots = leaders(few)
    for turn in [*range(SPARSE_ROUNDS), None]:
        roots = merged(roots, cross_links(few, roots, turn))
    owned = roots.withColumnRenamed("root", "component")
    least = owned.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = owned.join(least, "component").select("node", "component_id")
    out = sets.select("id", "n", "node").join(of_node, "node", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with its columns: the document of smallest id of each component.

    Rows that share an id stay together if one of them stays.
    """
    found = near_duplicates(docs, key, text)
    stays = F.max(F.col("id").eqNullSafe(F.col("component_id")))
    gone = found.groupBy("id").agg(stays.alias("stays")).where(~F.col("stays")).select(F.col("id").alias("__id"))
    return docs.join(gone, F.col(key).eqNullSafe(F.col("__id")), "left_anti")
