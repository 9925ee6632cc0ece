"""Packing documents into sequences along a space-filling curve.

A document's distinct tokens, hashed to a signed vector, are projected to a few
dimensions; the cell it falls in has a place on a Hilbert curve. Documents are
range-sorted by that place, so that neighbours on the curve, which share many tokens,
follow each other, and the stream of their tokens is cut into sequences of equal
length. The rest at the end is cut into sequences whose lengths are powers of two:
nothing is padded. No part of the sorted documents waits for another: running sums
within the parts and one sum a part place every token.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as c
from tidemark.session import materialize

#: Tokens of a sequence.
SEQUENCE = 2048
#: Dimensions of the curve and bits of each: the place on it fits a long.
AXES, BITS = 4, 15
#: Buckets tokens are hashed to.
BUCKETS = 1024
#: Bytes of text taken at once.
BATCH_BYTES = 4 << 20
#: Words whose tokens a task remembers, and the longest word it does so for.
KNOWN_WORDS, KNOWN_BYTES = 1 << 19, 64
#: Words encoded as one text.
CALL_WORDS = 1024
#: Pieces whose ids are widened at once.
SLICE_ROWS = 1024
_UNIT = 1 << 12


class WordCoder:
    """Ids of texts by a tokenizer that never joins across white space.

    Words are cut at ASCII white space and each distinct one is encoded once: the
    vocabulary's own normaliser and patterns look at no character beyond it. ``encode``
    gives, for each text, its ids and the character each of them begins at; ``plain``
    gives the ids of one word, or None where the word is not for it.
    """

    def __init__(self, encode: Callable[[list[str]], list[tuple[list[int], list[int]]]], size: int, end: int, plain: Callable[[str], list[int] | None] = lambda w: None):
        self.encode, self.size, self.plain = encode, size, plain
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.end = np.array([end], self.kind).tobytes()
        self.known: dict[bytes, bytes] = {}

    def _words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word; many words are encoded as one text and told apart by where the ids begin."""
        found, coded = {}, [self.plain(w.decode()) for w in new]
        sizes = np.cumsum([len(ids) if ids else 0 for ids in coded]) * np.dtype(self.kind).itemsize
        raw = np.fromiter(chain.from_iterable(ids for ids in coded if ids), self.kind).tobytes()
        ends = sizes.tolist()
        found = {w: raw[i:j] for w, ids, i, j in zip(new, coded, [0, *ends], ends) if ids is not None}
        new = [w for w, ids in zip(new, coded) if ids is None]
        groups = [new[i : i + CALL_WORDS] for i in range(0, len(new), CALL_WORDS)]
        texts = [[w.decode() for w in group] for group in groups]
        for group, words, (ids, begins) in zip(groups, texts, self.encode([" ".join(words) for words in texts])):
            starts = np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])
            cuts = np.searchsorted(begins, starts[1:]) * np.dtype(self.kind).itemsize
            raw = np.array(ids, self.kind).tobytes()
            found.update(zip(group, (raw[i:j] for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(raw)]))))
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text (of type ``kind``), with the end id behind."""
        split = [t.split() for t in texts]
        flat = list(chain.from_iterable(split))
        coded = list(map(self.known.get, flat))
        new = {w for w, ids in zip(flat, coded) if ids is None}
        if new:
            found = self._words(list(new))
            coded = [found[w] if ids is None else ids for w, ids in zip(flat, coded)]
            if len(self.known) > KNOWN_WORDS:
                self.known = {}
            self.known.update((w, ids) for w, ids in found.items() if len(w) <= KNOWN_BYTES)
        out, at = [], 0
        for words in split:
            out.append(b"".join(coded[at : at + len(words)]) + self.end)
            at += len(words)
        return out


#: Latin words without combining characters: composing them changes nothing, and lower case is letter by letter.
_LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


def word_coder(path: str, end: int = 1) -> WordCoder:
    """Coder of a ``tokenizers`` file with word ends; strings of its special tokens are those tokens, as by default.

    Latin words are encoded by ranks with the faster library: the file's merges make ids in
    ascending order, and a byte that no text has marks the end of a word. All other
    words, and those with a special token in them, go to the file's own library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    vocabulary, suffix = known["model"]["vocab"], known["model"]["end_of_word_suffix"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in known["model"]["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError(f"the merges of {path} don't make ids in ascending order")
    of, mark = c.byte_characters(), b"\xff"
    ranks = {bytes(of[ch] for ch in t.removesuffix(suffix)) + (mark if t.endswith(suffix) else b""): number for t, number in vocabulary.items()}
    by_rank = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    split = regex.compile(known["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
    special = [t["content"] for t in known["added_tokens"]]

    def plain(word: str) -> list[int] | None:
        if not _LATIN.fullmatch(word) or "<" in word and any(t in word for t in special):
            return None
        word = word.lower()
        if word.isalpha():
            return by_rank(word.encode() + mark)
        return [i for part in split(word) for i in by_rank(part.encode() + mark)]

    tokenizer = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[tuple[list[int], list[int]]]:
        return [(e.ids, [begin for begin, _ in e.offsets]) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return WordCoder(encode, max(tokenizer.get_vocab_size(), end + 1), end, plain)


def projection(size: int, axes: int = AXES, buckets: int = BUCKETS) -> np.ndarray:
    """What each token adds to a document's coordinates, as whole multiples of 1 / ``_UNIT``.

    A token is hashed to a bucket and a sign; the buckets' directions are Gaussian.
    Whole numbers add up alike in any order.
    """
    directions = np.round(np.random.default_rng(13).normal(size=(buckets, axes)) * _UNIT).astype(np.int64)
    with np.errstate(over="ignore"):
        hashed = c.mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sign = np.where(hashed >> np.uint64(63), -1, 1)
    return directions[(hashed % np.uint64(buckets)).astype(np.int64)] * sign[:, None]


def coordinates(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cell of every document along each axis, from its distinct tokens; evened out by a logistic curve."""
    wide = np.uint32 if len(sizes) * len(table) < 1 << 32 else np.uint64
    own = np.sort(np.repeat(np.arange(len(sizes), dtype=wide) * wide(len(table)), sizes) + ids.astype(wide))
    own = own[np.append(True, own[1:] != own[:-1])]
    of, token = (x.astype(np.int64) for x in np.divmod(own, wide(len(table))))
    distinct = np.bincount(of, minlength=len(sizes))
    sums = np.add.reduceat(table[token], np.cumsum(distinct) - distinct)  # every document has its end token
    spread = sums / (_UNIT * np.sqrt(distinct)[:, None])
    return np.minimum((1 << bits) - 1, (1 << bits) / (1 + np.exp(-1.702 * spread))).astype(np.uint64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell (one row, ``bits`` bits an axis) on the Hilbert curve, by Skilling's transformation."""
    x = [column.copy() for column in cells.astype(np.uint64).T]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(len(x)):
            set_ = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> np.uint64(b)) & one == one, flip ^ np.uint64((1 << b) - 1), flip)
    place = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for one_axis in x:
            place = place << one | ((one_axis ^ flip) >> np.uint64(b)) & one
    return place.astype(np.int64)


def _tokens(open_coder: Callable[[], WordCoder]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table, turn = None, None, TaskContext.get().partitionId() << 33
        for batch in batches:
            coder = coder or open_coder()
            table = projection(coder.size) if table is None else table
            raw, bounds = c.text_buffer(batch["text"])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + BATCH_BYTES, "right")) - 1)
                texts = [raw[bounds[i] : bounds[i + 1]].tobytes() for i in range(start, end)]
                coded = coder.ids(texts)
                flat = np.frombuffer(b"".join(coded), coder.kind)
                sizes = np.array([len(x) for x in coded], np.int64) // flat.itemsize
                place = hilbert(coordinates(flat, sizes, table))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), batch["id"].slice(start, end - start), pa.array(np.arange(turn, turn + end - start)), pa.array(sizes), pa.array(coded, pa.binary())],
                    ["curve", "id", "turn", "n", "ids"],
                )
                turn, start = turn + end - start, end

    return run


def starts_of(total: int, sequence: int) -> np.ndarray:
    """First tokens of the sequences behind the last full one, and the end: the rest in falling powers of two."""
    full, rest = total // sequence, total % sequence
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.cumsum([full * sequence, *sizes])


def _pieces(placed: DataFrame, total: int, sequence: int, width: int) -> DataFrame:
    """Pieces of documents at their places ``at`` in the stream of all ``total`` tokens; ids of ``width`` bytes."""
    tail, full = [int(x) for x in starts_of(total, sequence)], total // sequence
    behind = F.array(*[F.lit(x) for x in tail])

    def number(position: Column) -> Column:
        late = F.size(F.filter(behind, lambda x: x <= position)) - 1 + F.lit(full)
        return F.when(position < full * sequence, F.floor(position / sequence)).otherwise(late).cast("long")

    def first(at: Column) -> Column:
        late = F.get(behind, F.least(at - full, F.lit(len(tail) - 1)).cast("int"))
        return F.when(at < full, at * sequence).otherwise(late)

    span = F.sequence(number(F.col("at")), number(F.col("at") + F.col("n") - 1))
    each = placed.withColumn("sequence_id", F.explode(span))
    each = each.withColumn("opens", first(F.col("sequence_id"))).withColumn("closes", first(F.col("sequence_id") + 1))
    each = each.withColumn("begin", F.greatest("at", "opens")).withColumn("length", F.least(F.col("at") + F.col("n"), F.col("closes")) - F.col("begin"))
    start = F.col("begin") - F.col("at")
    part = F.substring("ids", (start * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    return each.select("id", start.alias("start"), "length", part.alias("ids"), F.col("n").alias("doc_tokens"), "sequence_id", (F.col("begin") - F.col("opens")).alias("offset"))


def _widened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        at = batch.schema.get_field_index("ids") if at is None else at
        for k in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(k, SLICE_ROWS)
            ids = pa.array([np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in some["ids"].to_pylist()], pa.binary())
            yield some.set_column(at, "ids", ids)


def pack(docs: DataFrame, open_coder: Callable[[], WordCoder], key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents.

    ``ids`` are the piece's ids as little-endian 32-bit numbers, ``start`` counts its
    document's ids before it, ``offset`` its sequence's. A null text is empty and has its
    end id alone. Documents of one place on the curve, copies above all, go by id and
    then by their place in the table; rows repeated in full are packed each. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    c.free_shuffles(spark)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    coded = materialize(rows.mapInArrow(_tokens(open_coder), f"curve long, id {kind}, turn long, n long, ids binary"))
    # only places and sizes are sorted and summed; the ids move once, to meet their place
    placed = c.ordered(coded.select("curve", "id", "turn", "n"), ["curve", "id", "turn"])
    upto = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select("turn", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    # one row a part: as many as the session's shuffles have, or one for a million documents
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("n").alias("tokens"))
    firsts = materialize(sums.select("part", "tokens", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("first")))
    total = firsts.agg(F.sum("tokens")).first()[0] or 0
    at = within.join(firsts.select("part", "first"), "part").select("turn", (F.col("first") + F.col("before")).alias("at"))
    width = 2 if open_coder().kind == "<u2" else 4
    pieces = _pieces(coded.join(at, "turn").select("id", "n", "ids", "at"), total, sequence, width)
    return pieces.mapInArrow(_widened, pieces.schema) if width == 2 else pieces
