"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood bigram and
unigram estimates and the uniform one. The mixture depends on how often the context
was seen, in buckets by powers of two, and is learned by expectation-maximisation on
the counts of documents held out of the estimates it weighs; the final estimates
count all training documents.

Documents are dealt over blocks by a hash of their id. A block asks once for each
of its distinct n-grams, with its own counts; n-gram buckets add up all blocks'
counts and answer in the order asked. So the table of counts is never in one
place, a frequent word is one row a block, and no token travels alone.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c
from tidemark.session import materialize

#: Bytes of text in a block, and bytes of text an n-gram bucket serves.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
#: Context-frequency buckets: unseen, then by powers of two.
CONTEXTS = 16
#: Grid of the held-out counts: quarters of a bit.
CELLS, QUARTER = 160, 4
ROUNDS = 40
LEAST_WEIGHT = 1e-6
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, first token of each text and one more); each text ends in an end token."""
    words, first = c.word_hashes(*c.text_buffer(texts), fold=True)
    n = len(first) - 1
    tokens = np.insert(words, first[1:], _END)
    first = first + np.arange(n + 1)
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[first[:-1]] = _BEGIN
    return tokens, context, first


def _bigrams(tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return c.mix(context * c._MORE[0] + tokens * c._MORE[1])


class _Keys:
    """Distinct n-grams of a block in a fixed order, and each token's place among them."""

    def __init__(self, texts):
        self.tokens, self.context, self.first = _tokens(texts)
        self.unigrams, self.at_token = np.unique(np.append(self.tokens, _BEGIN), return_inverse=True)
        self.at_begin, self.at_token = self.at_token[-1], self.at_token[:-1]
        self.at_context = np.searchsorted(self.unigrams, self.context)
        self.bigrams, self.at_bigram = np.unique(_bigrams(self.tokens, self.context), return_inverse=True)


def _ask(buckets: int):
    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        keys = _Keys(rows["text"])
        part = rows["part"].to_numpy()
        of = np.repeat(part, np.diff(keys.first))
        out: list[tuple[int, bytes]] = []
        counts = []
        for n in (1, 2):
            uni = np.bincount(keys.at_token[of == n], minlength=len(keys.unigrams))
            uni[keys.at_begin] += int((part == n).sum())
            counts.append((uni, np.bincount(keys.at_bigram[of == n], minlength=len(keys.bigrams))))
        found: dict[int, list] = {}
        for kind, known in enumerate((keys.unigrams, keys.bigrams)):
            for bucket, at, rest in c.split_keys(known, buckets):
                found.setdefault(bucket, [None, None])[kind] = (c.short(rest, 8 if kind == 0 else 6), c.narrow(counts[0][kind][at]), c.narrow(counts[1][kind][at]))
        out = [(bucket, c.pack(*(x for pair in both if pair is not None for x in pair), np.array([pair is not None for pair in both]))) for bucket, both in found.items()]
        block = rows["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(out), pa.int32()), "bucket": pa.array([b for b, _ in out], pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})

    return ask


def _halves(payload: bytes) -> list[tuple | None]:
    *arrays, there = c.unpack(payload)
    it = iter(arrays)
    return [(next(it), next(it), next(it)) if has else None for has in there]


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    asked = [_halves(p) for p in rows["payload"].to_pylist()]
    answers = [[] for _ in asked]
    facts = [0, 0, 0, 0]  # types and tokens, kept and all
    bucket = rows["bucket"][0].as_py()
    for kind in (0, 1):
        some = [(i, halves[kind]) for i, halves in enumerate(asked) if halves[kind] is not None]
        if not some:
            continue
        keys = np.concatenate([c.long(h[0]) for _, h in some])
        known, at = np.unique(keys, return_inverse=True)
        sums = [np.bincount(at, np.concatenate([h[n] for _, h in some]).astype(float), len(known)).astype(np.int64) for n in (1, 2)]
        kept, both = sums[0], sums[0] + sums[1]
        if kind == 0:
            begin = _BEGIN // np.uint64(rows["buckets"][0].as_py())
            real = known != begin if int(_BEGIN % np.uint64(rows["buckets"][0].as_py())) == bucket else np.ones(len(known), bool)
            facts = [int(((x > 0) & real).sum() if count else x[real].sum()) for x in (kept, both) for count in (True, False)]
        start = 0
        for i, h in some:
            part = at[start : start + len(h[0])]
            start += len(h[0])
            answers[i] = [*answers[i], c.narrow(kept[part]), c.narrow(both[part])]
    zero = [0] * (len(asked) - 1)
    return pa.table(
        {
            "block": rows["block"].cast(pa.int32()),
            "bucket": rows["bucket"].cast(pa.int32()),
            "payload": pa.array([c.pack(*a) for a in answers], pa.binary()),
            **{name: pa.array([value, *zero], pa.int64()) for name, value in zip(("types_kept", "tokens_kept", "types", "tokens"), facts)},
        }
    )


_ANSWER = "block int, bucket int, payload binary, types_kept long, tokens_kept long, types long, tokens long"


class _Counts:
    """Answered counts of a block's n-grams: kept and all, of each token, its context and their bigram."""

    def __init__(self, keys: _Keys, answers: pa.Table, buckets: int):
        got = {b: c.unpack(p) for b, p in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist())}
        tables = []
        used = dict.fromkeys(got, 0)
        for known in (keys.unigrams, keys.bigrams):
            kept, both = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            for bucket, at, _ in c.split_keys(known, buckets):
                k = used[bucket]
                kept[at], both[at] = got[bucket][k], got[bucket][k + 1]
                used[bucket] = k + 2
            tables.append((kept, both))
        (u_kept, u_all), (b_kept, b_all) = tables
        self.kept = u_kept[keys.at_token], u_kept[keys.at_context], b_kept[keys.at_bigram]
        self.all = u_all[keys.at_token], u_all[keys.at_context], b_all[keys.at_bigram]


def _context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(CONTEXTS - 1, 1 + np.floor(np.log2(np.maximum(count, 1))).astype(int)), 0)


def _cell(p: np.ndarray) -> np.ndarray:
    """Grid cell of a probability; the last one is zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(CELLS - 2, np.round(-np.log2(p) * QUARTER)), CELLS - 1).astype(int)


def _histogram(buckets: int, tokens_kept: int):
    def count(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("context", "bi", "uni", "n")})
        keys = _Keys(docs["text"])
        token, context, bigram = _Counts(keys, answers, buckets).kept
        cells = np.stack([_context_bucket(context), _cell(bigram / np.maximum(context, 1)), _cell(token / max(1, tokens_kept))], 1)
        found, n = np.unique(cells, axis=0, return_counts=True)
        return pa.table({"context": found[:, 0].astype(np.int64), "bi": found[:, 1].astype(np.int64), "uni": found[:, 2].astype(np.int64), "n": n.astype(np.int64)})

    return count


def mixture(cells: np.ndarray, types: int) -> np.ndarray:
    """Weights (context bucket, [bigram, unigram, uniform]) by expectation-maximisation on held-out counts.

    ``cells`` has rows (context bucket, bigram cell, unigram cell, count); a
    bucket without held-out tokens takes the next lower one's weights.
    """
    weights = np.full((CONTEXTS, 3), 1 / 3)
    value = np.append(2.0 ** (-np.arange(CELLS - 1) / QUARTER), 0.0)
    last = np.array([0.0, 0.5, 0.5])
    for b in range(CONTEXTS):
        some = cells[cells[:, 0] == b]
        if len(some):
            p = np.stack([value[some[:, 1]], value[some[:, 2]], np.full(len(some), 1 / (types + 1))], 1)
            w = np.full(3, 1 / 3)
            for _ in range(ROUNDS):
                share = p * w
                share /= share.sum(1, keepdims=True)
                w = (share * some[:, 3:4]).sum(0) / some[:, 3].sum()
            last = np.maximum(w, LEAST_WEIGHT) / np.maximum(w, LEAST_WEIGHT).sum()
        weights[b] = last
    return weights


def _score(buckets: int, types: int, tokens_all: int, weights: np.ndarray):
    def score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = _Keys(docs["text"])
        token, context, bigram = _Counts(keys, answers, buckets).all
        w = weights[_context_bucket(context)]
        p = w[:, 0] * (bigram / np.maximum(context, 1)) + w[:, 1] * (token / max(1, tokens_all)) + w[:, 2] / (types + 1)
        base = np.log10((token + 0.1) / (tokens_all + 0.1 * (types + 1)))
        at = keys.first[:-1]
        total = lambda x: np.add.reduceat(x, at)  # noqa: E731  every text has its end token
        return pa.table(
            {
                "id": docs["id"],
                "n_tokens": pa.array(np.diff(keys.first).astype(np.int64)),
                "n_known": pa.array(total((token > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(at), tokens_all, np.int64)),
                "base_score": pa.array(total(base)),
                "score": pa.array(total(np.log10(p))),
            }
        )

    return score


def score(docs: DataFrame, part: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``part`` says what a row is for: 1 training, 2 training and, in the step that
    learns the mixture, held out; 0 scored only. Null and empty texts are a single
    end token. Repeated rows count repeatedly and are scored alike. Without
    training rows the mixture is unigram and uniform in equal parts.
    """
    spark = docs.sparkSession
    c.free_shuffles(spark)
    total = c.text_bytes(docs, text)
    n, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    held = n // 10 + 1
    number = F.xxhash64("id")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), part.cast("int").alias("part"))
    # documents that may be held out have blocks of their own
    block = F.when(F.col("part") == 2, F.lit(n) + F.pmod(number, F.lit(held))).otherwise(F.pmod(number, F.lit(n)))
    blocks = rows.select(block.cast("int").alias("block"), "id", "text", "part")
    asked = blocks.groupBy("block").applyInArrow(_ask(buckets), "block int, bucket int, payload binary").withColumn("buckets", F.lit(buckets))
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER))
    facts = answers.agg(*[F.sum(name).alias(name) for name in ("types_kept", "tokens_kept", "types", "tokens")]).first()
    payloads = answers.select("block", "bucket", "payload")
    second = blocks.where("part = 2").groupBy("block").cogroup(payloads.where(F.col("block") >= n).groupBy("block"))
    cells = second.applyInArrow(_histogram(buckets, facts["tokens_kept"] or 0), "context long, bi long, uni long, n long")
    grid = cells.groupBy("context", "bi", "uni").agg(F.sum("n").alias("n")).orderBy("context", "bi", "uni").collect()
    weights = mixture(np.array([tuple(row) for row in grid], np.int64).reshape(-1, 4), facts["types_kept"] or 0)
    kind = rows.schema["id"].dataType.simpleString()
    last = blocks.groupBy("block").cogroup(payloads.groupBy("block"))
    return last.applyInArrow(
        _score(buckets, facts["types"] or 0, facts["tokens"] or 0, weights),
        f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
