"""Helpers the text operators share: words, hashes, blocks of documents, folds.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. Python tasks hash words straight from Arrow
buffers with numpy, in slices of bounded size, so that neither a large batch nor
one very long text needs more than a few megabytes of scratch memory beyond
eight bytes a word.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of text hashed at once.
SLICE_BYTES = 1 << 20
#: Bytes of text a block of documents aims at.
BLOCK_BYTES = 8 << 20
#: Rows of a range-sorted part: as many parts as the session's shuffles have, within these bounds.
LEAST_PART, MOST_PART = 1 << 14, 1 << 20

_random = np.random.default_rng(20240229)
_LETTERS = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS[_IS_SPACE] = 0
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MORE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _STEP, np.uint64))])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _slices(raw: np.ndarray, bounds: np.ndarray):
    """Cut points that fall on a text's start or just behind white space."""
    at, end = 0, len(raw)
    while at < end:
        stop = min(end, at + SLICE_BYTES)
        if stop < end:
            k = np.searchsorted(bounds, stop, "right") - 1
            if bounds[k] > at:
                stop = int(bounds[k])
            else:  # inside one long text
                while stop < end:
                    gap = np.flatnonzero(_IS_SPACE[raw[stop : stop + SLICE_BYTES]])
                    if len(gap):
                        stop += int(gap[0]) + 1
                        break
                    stop = min(end, stop + SLICE_BYTES)
                k = np.searchsorted(bounds, at, "right")
                stop = min(stop, int(bounds[k])) if k < len(bounds) and bounds[k] > at else stop
        yield at, stop
        at = stop


def word_hashes(raw: np.ndarray, bounds: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and, for each text, the index of its first word (one more at the end).

    ``fold`` takes A-Z as a-z. Equal words have equal hashes wherever they stand.
    """
    table = _FOLDED if fold else _LETTERS
    hashes, starts_all = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for a, b in _slices(raw, bounds):
            part = raw[a:b]
            space = _IS_SPACE[part]
            after = np.empty(b - a, bool)
            after[0] = True
            after[1:] = space[:-1]
            lo, hi = np.searchsorted(bounds, [a, b])
            inner = bounds[lo:hi] - a
            after[inner[inner < b - a]] = True
            starts = np.flatnonzero(after & ~space)
            if not len(starts):
                continue
            first = int(starts[0])
            lengths = np.diff(np.append(starts, b - a))
            place = np.arange(first, b - a) - np.repeat(starts, lengths)
            worth = table[part[first:]] * _power(int(lengths.max()) + 1)[place]
            hashes.append(mix(np.add.reduceat(worth, starts - first)))
            starts_all.append(starts + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), bounds)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs across texts are the caller's to skip."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n] * _MORE[0]
        for k in range(1, size):
            total = total + words[k : k + n] * _MORE[k % 64]
        return mix(total)


def run_hash(words: np.ndarray) -> np.uint64:
    """Hash of one whole run of words of any length, apart from those of ``window_hashes``."""
    with np.errstate(over="ignore"):
        return np.uint64(mix(np.array([(words * _power(len(words) + 1)[1 : len(words) + 1]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))[0])


def fold_of(key: Column, folds: int) -> Column:
    """Fold of a row: crc32 of the key as text, modulo ``folds``; null goes by the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table; one number reaches the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0)


def blocks_of(docs: DataFrame, key: str, text: str, total: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, id, text): documents dealt over blocks of about ``block_bytes`` by a hash of id.

    Each block is small enough for one Python call. The number of blocks grows
    with the text; their content is the same in every evaluation.
    """
    n = max(1, -(-total // block_bytes))
    row = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return row.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "text")


def range_sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` dealt over parts of bounded size in one global order and sorted within them.

    Give ``order`` a last column that tells rows apart: then equal rows spread over parts
    too. ``rows`` are counted and read twice, so they should be a written table.
    """
    n = rows.count()
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(max(shuffles, -(-n // MOST_PART)), -(-n // LEAST_PART)))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` range-sorted and written, with ``part`` and ``place``: the sorted part and the row's place in it."""
    placed = range_sorted(rows, order).withColumn("__number", F.monotonically_increasing_id())
    low = F.lit((1 << 33) - 1)
    return materialize(placed.select(*rows.columns, F.shiftright("__number", 33).alias("part"), F.col("__number").bitwiseAND(low).alias("place")))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value."""
    return pickle.dumps(arrays, 5)


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(data)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def split_keys(keys: np.ndarray, buckets: int):
    """(bucket, positions in ``keys``, rest of the key) for each bucket; bucket and rest make up the key."""
    of = keys % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1, dtype=np.uint64))
    for bucket in range(buckets):
        at = order[edges[bucket] : edges[bucket + 1]]
        if len(at):
            yield bucket, at, keys[at] // np.uint64(buckets)


def short(keys: np.ndarray, size: int = 6) -> np.ndarray:
    """The low ``size`` bytes of every key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def long(keys: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(keys), 8), np.uint8)
    whole[:, : keys.shape[1]] = keys
    return whole.view("<u8").reshape(-1)


def free_shuffles(spark) -> None:
    """Let Spark delete a finished query's shuffle files at once instead of with the driver's garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def byte_characters() -> dict[str, int]:
    """The character a byte-level vocabulary writes for each byte: printable ones as they are, the rest from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
