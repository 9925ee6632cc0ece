"""Alignment of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the farthest-right token
that overlaps it: a token of A to the token of B that holds its last byte, a token of
B to the token of A that does, unless that one ends with it. Doubling the pointers of
a whole batch of documents at once leads every token to the last token of its
component, the B token that ends where an A token ends; tokens of one terminal are one
group. Overlapping pairs of tokens are links.

How often the corpus links two ids needs all documents: a block of documents lists its
distinct pairs of ids with their numbers of links, the numbers are added up over all
blocks, and each block gets the sums of its own pairs back. Texts are encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as c
from tidemark.session import materialize

#: Bytes of text in a block, unless one text alone is longer.
BLOCK_BYTES = 4 << 20
#: Characters of a text encoded in one call, where a safe place to cut is found.
CALL_CHARS = 1 << 18
#: Characters encoded at once: a tokenizer's own record of a text takes many times its size.
BATCH_CHARS = 1 << 18
#: A single space between other characters: neither tokenizer joins across the place before it.
_CUT = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Columns of a block's numbers of each document.
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Coder:
    """A tokenizer as a function from texts to ids, and the bytes of each id.

    ``lossless`` says that the ids' bytes are a space and the text whatever the text.
    """

    def __init__(self, encode: Callable[[list[str]], list], tokens: list[bytes], lossless: bool = False):
        self.encode, self.tokens, self.lossless = encode, tokens, lossless
        self.length = np.array([len(t) for t in tokens], np.int64)


def byte_level(path: str, pattern: str) -> Coder:
    """Byte-level BPE of a ``tokenizers`` file; special tokens are plain text; encodes a space and the text.

    The file's merges make ids in ascending order, so the ids are ranks and the faster
    library for ranks gives the same ids; ``pattern`` is the one byte-level files split by.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    of = c.byte_characters()
    ranks = {bytes(of[ch] for ch in token): number for token, number in model["vocab"].items()}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])) or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"the merges of {path} don't make ids in ascending order")
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Coder(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], sorted(ranks, key=ranks.get), lossless=True)


def pieces(path: str) -> Coder:
    """A ``sentencepiece`` model, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        one = _BYTE.fullmatch(piece)
        tokens.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
    return Coder(lambda texts: model.encode(texts, num_threads=1), tokens)


def _cut(text: str) -> list[str]:
    """Parts of a long text, each without the space at its start, which both coders add again."""
    if len(text) <= CALL_CHARS:
        return [text]
    out, start = [], 0
    while len(text) - start > CALL_CHARS:
        found = _CUT.search(text, start + CALL_CHARS)
        if not found:
            break
        out.append(text[start : found.end()])
        start = found.end() + 1
    return [*out, text[start:]]


def _encode(coder: Coder, texts: list[str]) -> list[list[int]]:
    parts = [_cut(t) for t in texts]
    flat, ids = [p for some in parts for p in some], []
    at = 0
    while at < len(flat):
        end, size = at, 0
        while end < len(flat) and (end == at or size + len(flat[end]) <= BATCH_CHARS):
            size += len(flat[end])
            end += 1
        ids += coder.encode(flat[at:end])
        at = end
    out, k = [], 0
    for some in parts:
        out.append(ids[k] if len(some) == 1 else [i for one in ids[k : k + len(some)] for i in one])
        k += len(some)
    return out


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each token, A's first and then B's, the B token its component ends with.

    The ends are byte offsets that ascend and share their last one; tokens are not empty.
    """
    a, b = len(end_a), len(end_b)
    to_b = np.searchsorted(end_b, end_a)  # the B token with A's last byte
    to_a = np.searchsorted(end_a, end_b)
    farther = end_a[to_a] > end_b
    points = np.concatenate([a + to_b, np.where(farther, to_a, a + np.arange(b))])
    while True:
        doubled = points[points]
        if np.array_equal(doubled, points):
            return points - a
        points = doubled


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (A token, B token) of all pairs that share a byte, by A."""
    start = np.concatenate([[0], end_a[:-1]])
    first, last = np.searchsorted(end_b, start, "right"), np.searchsorted(end_b, end_a)
    many = last - first + 1
    at = np.repeat(np.arange(len(end_a)), many)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[at]


class Aligner:
    """Both coders and what is needed to align a batch of texts."""

    def __init__(self, coder_a: Coder, coder_b: Coder):
        self.a, self.b = coder_a, coder_b
        # text of an id that the group goes on behind, and of one that ends its side of the group
        self.shown_a = [f"{i}{end}".encode() for i in range(len(coder_a.tokens)) for end in (",", "|")]
        self.shown_b = [f"{i}{end}".encode() for i in range(len(coder_b.tokens)) for end in (",", ";")]
        self.shown = self.shown_a + self.shown_b

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both coders for each text; none where their bytes are not a space and the text."""
        given = [t for t in texts if t]
        both = zip(given, _encode(self.a, given), _encode(self.b, given))
        out = []
        for text in texts:
            if not text:
                out.append(([], []))
                continue
            text, a, b = next(both)
            want = b" " + text.encode()
            same = all(coder.lossless or b"".join(map(coder.tokens.__getitem__, ids)) == want for coder, ids in ((self.a, a), (self.b, b)))
            out.append((a, b) if same else ([], []))
        return out

    def align(self, texts: list[str | None]) -> dict:
        """Numbers and group digests of every text, and all links as (text, A id, B id)."""
        both = self.tokens(texts)
        sizes = np.array([(len(a), len(b)) for a, b in both], np.int64).reshape(-1, 2)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x[k] for x in both), np.int64, int(sizes[:, k].sum())) for k in (0, 1))
        row_a, row_b = (np.repeat(np.arange(len(texts)), sizes[:, k]) for k in (0, 1))
        end_a, end_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        if not len(ids_a):
            zero = np.zeros(len(texts), np.int64)
            return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups": [""] * len(texts), "links": (zero[:0], zero[:0], zero[:0])}
        terminal = terminals(end_a, end_b)
        group_a, group_b = terminal[: len(ids_a)], terminal[len(ids_a) :]
        n_groups = np.bincount(row_b[np.unique(group_b)], minlength=len(texts))
        at_a, at_b = overlaps(end_a, end_b)
        # the text of the groups: A's ids of a group, then B's; each id's place follows from the groups before it
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        shown = np.empty(len(ids_a) + len(ids_b), np.int64)
        shown[place_a] = ids_a * 2 + last_a
        shown[place_b] = len(self.shown_a) + ids_b * 2 + last_b
        digests, start = [], 0
        for n in sizes.sum(1).tolist():
            text = b"".join(map(self.shown.__getitem__, shown[start : start + n].tolist()))[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if n else "")
            start += n
        return {
            "n_a": sizes[:, 0],
            "n_b": sizes[:, 1],
            "n_groups": n_groups,
            "n_links": np.bincount(row_a[at_a], minlength=len(texts)),
            "groups": digests,
            "links": (row_a[at_a], ids_a[at_a], ids_b[at_b]),
        }


def _block(aligner: Aligner, number: int, ids: pa.Array, texts: list[str | None]) -> dict:
    made = aligner.align(texts)
    row, a, b = made["links"]
    pairs, at = np.unique(a << 32 | b, return_inverse=True)
    # each text's distinct pairs, by their place in the block's list
    own, n = np.unique(row * np.int64(len(pairs) or 1) + at, return_counts=True)
    counts = np.bincount(own // (len(pairs) or 1), minlength=len(texts))
    own = own % (len(pairs) or 1)
    return {
        "block": number,
        "ids": ids,
        "pairs": pairs.tolist(),
        "links": np.bincount(own, n, len(pairs)).astype(np.int64).tolist(),
        "payload": c.pack(*[c.narrow(made[k]) for k in _COUNTS], c.narrow(counts), c.narrow(own), c.narrow(n)),
        "groups": made["groups"],
    }


def _blocks(open_a: Callable[[], Coder], open_b: Callable[[], Coder], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, made = None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            aligner = aligner or Aligner(open_a(), open_b())
            size = pa.compute.fill_null(pa.compute.binary_length(batch["text"].cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(size)
            start = 0
            while start < batch.num_rows:
                room = (upto[start - 1] if start else 0) + BLOCK_BYTES
                end = max(start + 1, int(np.searchsorted(upto, room, "right")))
                some = batch.slice(start, end - start)
                row = _block(aligner, part << 32 | made, some["id"], some["text"].to_pylist())
                yield pa.RecordBatch.from_pydict({k: pa.array([v], schema.field(k).type) if k != "ids" else pa.ListArray.from_arrays([0, len(v)], v) for k, v in row.items()}, schema=schema)
                made, start = made + 1, end

    return run


def _settle(kind: pa.DataType):
    def settle(key: tuple, blocks: pa.Table, sums: pa.Table) -> pa.Table:
        out = []
        pairs = np.concatenate([np.zeros(0, np.int64), *[p.values.to_numpy() for p in sums["pairs"].chunks]])
        order = np.argsort(pairs)
        total, best = (np.concatenate([np.zeros(0, np.int64), *[p.values.to_numpy(zero_copy_only=False) for p in sums[name].chunks]])[order] for name in ("totals", "bests"))
        for k in range(blocks.num_rows):  # one row a block
            *numbers, counts, own, n = c.unpack(blocks["payload"][k].as_py())
            row = np.repeat(np.arange(len(counts)), counts)
            add = lambda x: np.bincount(row, x, len(counts)).astype(np.int64)
            n = n.astype(np.int64)
            sums_of = np.zeros(len(counts), np.int64)
            np.add.at(sums_of, row, n * total[own])
            out.append(
                pa.table(
                    {
                        "id": blocks["ids"][k].values.cast(kind),
                        **{name: pa.array(x.astype(np.int64)) for name, x in zip(_COUNTS, numbers)},
                        "n_best": pa.array(add(n * (total[own] == best[own]))),
                        "count_sum": pa.array(sums_of),
                        "groups": blocks["groups"][k].values,
                    }
                )
            )
        return pa.concat_tables(out)

    return settle


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links of every pair of ids over all blocks, and the most that its B id has with any A id.

    Blocks give each of their pairs once; the sums are partial on the map side. A B id
    has at most one row for each id of A.
    """
    each = blocks.select(F.explode(F.arrays_zip("pairs", "links")).alias("one")).select(F.col("one.pairs").alias("pair"), F.col("one.links").alias("n"))
    totals = each.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return totals.withColumn("best", F.max("total").over(Window.partitionBy(of_b)))


def align(docs: DataFrame, open_a: Callable[[], Coder], open_b: Callable[[], Coder], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    ``open_a`` and ``open_b`` open the coders in a task; both encode the text behind a
    space. ``groups`` is the digest of the groups' ids. Null and empty texts, and texts
    whose tokens' bytes are not a space and the text, have no tokens: zeros and an empty
    ``groups``. Links of rows repeated in full count repeatedly. Long texts are encoded
    in parts, cut before single spaces, where no token crosses. An empty table gives an
    empty result; other columns are not read.
    """
    c.free_shuffles(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    arrow = pa.schema([("block", pa.int64()), ("ids", pa.list_(_arrow_type(rows))), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())), ("payload", pa.binary()), ("groups", pa.list_(pa.string()))])
    made = rows.mapInArrow(_blocks(open_a, open_b, arrow), f"block long, ids array<{kind}>, pairs array<long>, links array<long>, payload binary, groups array<string>")
    blocks = materialize(made)
    totals = pair_counts(blocks)
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    answers = asked.join(totals, "pair").groupBy("of").agg(*[F.collect_list(x).alias(f"{x}s") for x in ("pair", "total", "best")])
    own = blocks.select("block", "ids", "payload", "groups")
    numbers = ", ".join(f"{x} long" for x in (*_COUNTS, "n_best", "count_sum"))
    return own.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_settle(_arrow_type(rows)), f"id {kind}, {numbers}, groups string")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)
