"""Removal of repeated word passages by suffix automata of reference shards.

A passage is a window of ``WINDOW`` words or any longer run. Each window has an
anchor, the run of ``ANCHOR`` words in it with the least hash, so equal windows have
equal anchors. Blocks of documents ask for their anchors which other documents have
them; runs of windows whose anchors are shared are fragments, and all fragments of one
origin (the first document with the anchor) meet in one reference shard. A shard reads its distinct
fragments in the order of their first document: each is streamed through the suffix automaton of
what came before, whose matching statistics tell from where every window is known,
and the parts not known yet extend the automaton. Blocks get back, for each
distinct fragment, the first document of each of its windows.

A passage copied into very many documents is one fragment a block, however often it
occurs, and only what a shard has not seen before enlarges its automaton.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c

WINDOW = 13
ANCHOR = 5
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
#: Bytes of all text a reference shard stands for; only its shared fragments meet there.
SHARD_BYTES = 4 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Suffix automaton of several word strings; each state knows the first document of its substrings."""

    def __init__(self):
        self.length, self.link, self.first = [0], [-1], [0]
        # most states have a single way on; the others are in ``more``
        self.word, self.to = [None], [0]
        self.more: dict[tuple[int, int], int] = {}
        self.ways: dict[int, list[int]] = {}

    def _new(self, length: int, first: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.first.append(first)
        self.word.append(None)
        self.to.append(0)
        return len(self.length) - 1

    def _get(self, state: int, word: int) -> int:
        """Following state, or -1."""
        if self.word[state] == word:
            return self.to[state]
        return self.more.get((state, word), -1)

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] is None or self.word[state] == word:
            self.word[state], self.to[state] = word, to
        else:
            if (state, word) not in self.more:
                self.ways.setdefault(state, []).append(word)
            self.more[state, word] = to

    def _copy(self, state: int, length: int) -> int:
        clone = self._new(length, self.first[state])
        self.link[clone] = self.link[state]
        self.word[clone], self.to[clone] = self.word[state], self.to[state]
        for word in self.ways.get(state, ()):
            self.more[clone, word] = self.more[state, word]
        if state in self.ways:
            self.ways[clone] = list(self.ways[state])
        return clone

    def add(self, words: list[int], document: int) -> None:
        """Extend by one string; strings come in ascending order of document."""
        last = 0
        for word in words:
            known = self._get(last, word)
            if known >= 0:
                if self.length[known] == self.length[last] + 1:
                    last = known
                    continue
                last = self._split(last, word, known)
                continue
            state = self._new(self.length[last] + 1, document)
            at = last
            while at >= 0 and self._get(at, word) < 0:
                self._set(at, word, state)
                at = self.link[at]
            if at >= 0:
                known = self._get(at, word)
                self.link[state] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
            last = state

    def _split(self, at: int, word: int, known: int) -> int:
        clone = self._copy(known, self.length[at] + 1)
        self.link[known] = clone
        while at >= 0 and self._get(at, word) == known:
            self._set(at, word, clone)
            at = self.link[at]
        return clone

    def origins(self, words: list[int], window: int) -> list[int | None]:
        """For each window of ``words``, the first document known to hold it, or None."""
        length, link, first, one, to, more = self.length, self.link, self.first, self.word, self.to, self.more
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while True:
                following = to[state] if one[state] == word else more.get((state, word), -1)
                if following >= 0:
                    state, matched = following, matched + 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            # keep to the state of the last ``window`` words: longer matches have later first documents
            while matched >= window and length[link[state]] >= window:
                state = link[state]
            if matched > length[state]:
                matched = length[state]
            if i >= window - 1:
                out.append(first[state] if matched >= window else None)
        return out


class _Windows:
    """Word hashes of a block, its windows and their anchors."""

    def __init__(self, rows: pa.Table):
        self.ids = rows["id"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.words, self.first = c.word_hashes(*c.text_buffer(rows["text"]))
        n = len(self.words) - WINDOW + 1
        self.document = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        if n <= 0:
            self.start = self.anchor = np.zeros(0, np.int64)
            self.grams = np.zeros(0, np.uint64)
            return
        self.grams = c.window_hashes(self.words, ANCHOR)
        whole = self.document[:n] == self.document[WINDOW - 1 :]
        self.start = np.flatnonzero(whole)
        self.anchor = np.zeros(len(self.start), np.int64)
        views = np.lib.stride_tricks.sliding_window_view(self.grams, WINDOW - ANCHOR + 1)
        for at in range(0, len(self.start), 1 << 18):
            some = self.start[at : at + (1 << 18)]
            self.anchor[at : at + (1 << 18)] = some + views[some].argmin(1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors with the least and the greatest document that has them."""
        at = np.unique(self.anchor)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _least_greatest(self.grams[at], self.ids[self.document[at]], self.ids[self.document[at]])


def _least_greatest(keys: np.ndarray, least: np.ndarray, greatest: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys, least, greatest = keys[order], least[order], greatest[order]
    cut = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    return keys[cut], np.minimum.reduceat(least, cut), np.maximum.reduceat(greatest, cut)


def _table(block: int, out: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(out), pa.int32()), "bucket": pa.array([b for b, _ in out], pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})


def _ask_anchors(buckets: int):
    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        keys, least, greatest = _Windows(rows).anchors()
        base = int(least.min()) if len(least) else 0
        out = []
        for bucket, at, rest in c.split_keys(keys, buckets):
            several = greatest[at] != least[at]
            out.append((bucket, c.pack(c.short(rest), np.int64(base), c.narrow(least[at] - base), several)))
        return _table(rows["block"][0].as_py(), out)

    return ask


def _answer_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    """For each asked anchor whether two documents share it, and the first of the sharers'."""
    asked = [c.unpack(p) for p in rows["payload"].to_pylist()]
    keys = np.concatenate([c.long(a[0]) for a in asked])
    least = np.concatenate([a[2].astype(np.int64) + a[1] for a in asked])
    several = np.concatenate([a[3] for a in asked])
    known, at = np.unique(keys, return_inverse=True)
    _, low, high = _least_greatest(keys, least, least)
    shared = (low != high) | (np.bincount(at, several, len(known)) > 0)
    ends = np.cumsum([len(a[0]) for a in asked])[:-1]
    out = []
    for part in np.split(at, ends):
        yes = shared[part]
        out.append(c.pack(np.packbits(yes), low[part[yes]]))
    return pa.table({"block": rows["block"].cast(pa.int32()), "bucket": rows["bucket"].cast(pa.int32()), "payload": pa.array(out, pa.binary())})


class _Fragments:
    """Distinct fragments of a block by shard, in a fixed order, and where they occur."""

    def __init__(self, windows: _Windows, answers: pa.Table, buckets: int, shards: int):
        keys, _, _ = windows.anchors()
        shard = np.full(len(keys), -1, np.int64)
        got = {b: c.unpack(p) for b, p in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist())}
        for bucket, at, _ in c.split_keys(keys, buckets):
            bits, origin = got[bucket]
            yes = np.unpackbits(bits, count=len(at)).astype(bool)
            with np.errstate(over="ignore"):
                shard[at[yes]] = (c.mix(origin.astype(np.uint64) * _SPREAD) % np.uint64(shards)).astype(np.int64)
        start = windows.start
        self.by_shard: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        if not len(start):
            return
        of = shard[np.searchsorted(keys, windows.grams[windows.anchor])]
        document = windows.document[start]
        new = np.append(True, (of[1:] != of[:-1]) | (document[1:] != document[:-1]) | (start[1:] != start[:-1] + 1))
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(start))
        content = c.short(windows.words, 5)
        for a, b in zip(begins.tolist(), ends.tolist()):
            if of[a] >= 0:
                first = int(start[a])
                found = self.by_shard.setdefault(int(of[a]), {})
                found.setdefault(content[first : int(start[b - 1]) + WINDOW].tobytes(), []).append((int(document[a]), first))


def _ask_fragments(buckets: int, shards: int):
    def ask(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(0, [])
        windows = _Windows(docs)
        fragments = _Fragments(windows, answers, buckets, shards).by_shard
        out = []
        for shard, found in fragments.items():
            contents = sorted(found)
            least = np.array([min(int(windows.ids[d]) for d, _ in found[x]) for x in contents], np.int64)
            out.append((shard, c.pack(np.array([len(x) for x in contents], np.int64), least, np.frombuffer(b"".join(contents), np.uint8))))
        return _table(docs["block"][0].as_py(), out)

    return ask


def _runs(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    values = np.array(values, np.int64)
    cut = np.append(0, np.flatnonzero(values[1:] != values[:-1]) + 1)
    return cut, values[cut]


def _answer_fragments(key: tuple, rows: pa.Table) -> pa.Table:
    """Run-length coded first documents of the windows of each asked fragment."""
    asked, earliest = [], {}
    for payload in rows["payload"].to_pylist():
        sizes, least, data = c.unpack(payload)
        data, at, own = data.tobytes(), 0, []
        for size, document in zip(sizes.tolist(), least.tolist()):
            content = data[at : at + size]
            at += size
            own.append(content)
            earliest[content] = min(document, earliest.get(content, document))
        asked.append(own)
    automaton = SuffixAutomaton()
    result = {}
    for content, document in sorted(earliest.items(), key=lambda x: (x[1], x[0])):
        words = c.long(np.frombuffer(content, np.uint8).reshape(-1, 5)).tolist()
        origin = automaton.origins(words, WINDOW)
        at, n = 0, len(origin)
        while at < n:  # what is new extends the automaton
            if origin[at] is not None:
                at += 1
                continue
            end = at
            while end < n and origin[end] is None:
                origin[end] = document
                end += 1
            automaton.add(words[at : end + WINDOW - 1], document)
            at = end
        result[content] = _runs(origin)
    out = []
    for own in asked:
        runs = [result[x] for x in own]
        cuts = np.array([len(a) for a, _ in runs], np.int64)
        out.append(c.pack(cuts, np.concatenate([a for a, _ in runs]), np.concatenate([b for _, b in runs])))
    return pa.table({"block": rows["block"].cast(pa.int32()), "bucket": rows["bucket"].cast(pa.int32()), "payload": pa.array(out, pa.binary())})


_OUT = "n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string"


def _remove(buckets: int, shards: int):
    def remove(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        windows = _Windows(docs)
        of_shard = answers["shards"].to_pylist()
        anchors = answers.filter(pa.array([not x for x in of_shard], pa.bool_()))
        origins = answers.filter(pa.array(of_shard, pa.bool_()))
        change = np.zeros(len(windows.words) + 1, np.int64)
        if len(windows.start):
            got = {b: c.unpack(p) for b, p in zip(origins["bucket"].to_pylist(), origins["payload"].to_pylist())}
            for shard, found in _Fragments(windows, anchors, buckets, shards).by_shard.items():
                cuts, starts, values = got[shard]
                ends = np.cumsum(cuts)
                for content, b, n in zip(sorted(found), ends.tolist(), cuts.tolist()):
                    begin, origin = starts[b - n : b], values[b - n : b]
                    stop = np.append(begin[1:], len(content) // 5 - WINDOW + 1)
                    for document, first in found[content]:
                        known = origin < windows.ids[document]
                        np.add.at(change, first + begin[known], 1)
                        np.add.at(change, first + stop[known] + WINDOW - 1, -1)
        gone = np.cumsum(change)[:-1] > 0
        spans, kept, removed = [], [], []
        for i, one in enumerate(docs["text"].to_pylist()):
            a, b = windows.first[i], windows.first[i + 1]
            words, mask = (one or "").encode("utf-8", "replace").split(), gone[a:b]
            n = int(mask.sum())
            removed.append(n)
            if n:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in edge.reshape(-1, 2)])
                words = [w for w, x in zip(words, mask.tolist()) if not x]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode("utf-8"))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table({"id": docs["id"], "n_words": pa.array(np.diff(windows.first)), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.string())})

    return remove


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of every row; ``key`` is a whole number.

    A word goes if a window that covers it, and lies in one document, also starts
    in a document of smaller id. ``spans`` are the maximal runs of removed words,
    ``kept`` the other words joined by single spaces. Null, empty and short texts
    lose nothing. Rows that share an id are one document and remove nothing from
    each other; a null id counts as the smallest. Words are compared by hashes (13 of
    40 bits in a row).
    """
    c.free_shuffles(docs.sparkSession)
    total = c.text_bytes(docs, text)
    buckets, shards = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // SHARD_BYTES))
    with_id = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**62))).alias("id"), F.col(text).alias("text"))
    blocks = c.blocks_of(with_id, "id", "text", total, BLOCK_BYTES)
    shape = "block int, bucket int, payload binary"
    known = blocks.groupBy("block").applyInArrow(_ask_anchors(buckets), shape).groupBy("bucket").applyInArrow(_answer_anchors, shape)
    asked = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_ask_fragments(buckets, shards), shape)
    origins = asked.groupBy("bucket").applyInArrow(_answer_fragments, shape)
    answers = known.withColumn("shards", F.lit(False)).unionByName(origins.withColumn("shards", F.lit(True)))
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(buckets, shards), "id long, " + _OUT)
    return out.withColumn("id", F.when(F.col("id") != -(2**62), F.col("id")))
