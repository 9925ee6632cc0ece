"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read a clause's words side by side. *Insult* and *threat*
recognise words or word beginnings, whose weights are learned from labels. *Target*
remembers an addressee, *negation* a denial shortly before, *reported speech* a verb
of saying or a quotation. Their composition, built state by state as clauses need
it, gives every insult or threat a factor by its surroundings, and a clause the sum
of its weighted matches. A document's log odds are those of texts without matches
plus its clauses' scores; words count only within the clause that holds them.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each label used for learning, about; they bound all that is gathered.
SAMPLE_TOXIC, SAMPLE_CLEAN = 5000, 10_000
#: Beginnings of words that may form a pattern.
BEGINNINGS = (4, 5, 6, 7)
#: A pattern needs this many toxic rows, this share of them, and this ratio of its rates.
LEAST_ROWS, LEAST_SHARE, LEAST_RATIO = 5, 0.002, 25.0
MOST_PATTERNS = 4000
MOST_WEIGHT = 8.0

# Function words in English, German, French and Spanish.
TARGETS = frozenset("you your yours he she they them du dich dir ihr euch sie tu te toi vous il elle ils tú ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not never no cannot nicht nie kein keine ne pas jamais non nunca jamás sin".split())
REPORTS = frozenset("said says say wrote writes quoted claims claimed told sagte sagt schrieb dit disait écrit dijo dice escribió".split())
THREATS = frozenset("kill murder hurt beat destroy shoot burn töten umbringen schlagen tuer frapper matar golpear".split())
QUOTES = frozenset("\"“”„«»")
#: Words a negation reaches over.
REACH = 3
FACTORS = {"target": 1.25, "negated": 0.6, "reported": 0.7}
#: Weight of a threat verb when an addressee is in the clause; without one it is nothing.
THREAT_WEIGHT = 1.0

_words = regex.compile(r"[\p{L}\p{N}_]+")
_clauses = regex.compile(r"[^.!?;:\n]+")
_tokens = regex.compile(r"[\p{L}\p{N}_]+|[\"“”„«»]")


class _Reach:
    """Transducer that remembers a word of its list for a number of words (0: to the clause's end)."""

    def __init__(self, words: frozenset, reach: int):
        self.words, self.reach = words, reach

    def step(self, state: int, word: str) -> int:
        if word in self.words:
            return self.reach or 1
        return state - 1 if self.reach and state else state


class _Speech:
    """Reported speech: after a verb of saying (2) or within quotation marks (odd)."""

    def step(self, state: int, word: str) -> int:
        if word in QUOTES:
            return state ^ 1
        return state | 2 if word in REPORTS else state


class Grammar:
    """Composition of the transducers; ``patterns`` maps words, or beginnings ending in *, to weights."""

    def __init__(self, patterns: dict[str, float], bias: float):
        self.bias = bias
        self.whole = {p: w for p, w in patterns.items() if not p.endswith("*")}
        self.begins = {n: {p[:-1]: w for p, w in patterns.items() if p.endswith("*") and len(p) == n + 1} for n in BEGINNINGS}
        self.parts = (_Reach(TARGETS, 0), _Reach(NEGATIONS, REACH), _Speech())
        self.moves: dict[tuple, tuple] = {}  # composed transitions met so far, by state and kind of word
        self.marked = TARGETS | NEGATIONS | REPORTS | QUOTES

    def insult(self, word: str) -> float:
        weight = self.whole.get(word, 0.0)
        for n, table in self.begins.items():
            if table and len(word) > n:
                weight = max(weight, table.get(word[:n], 0.0))
        return weight

    def _move(self, state: tuple, word: str) -> tuple:
        key = state, word if word in self.marked else ""
        if key not in self.moves:
            self.moves[key] = tuple(part.step(at, word) for part, at in zip(self.parts, state))
        return self.moves[key]

    def clause(self, words: list[str]) -> float:
        """Sum of the clause's weighted matches."""
        aimed = any(word in TARGETS for word in words)
        state, total = (0, 0, 0), 0.0
        for word in words:
            weight = self.insult(word)
            if not weight and aimed and word in THREATS:
                weight = THREAT_WEIGHT
            if weight:
                if aimed:
                    weight *= FACTORS["target"]
                if state[1]:
                    weight *= FACTORS["negated"]
                if state[2]:
                    weight *= FACTORS["reported"]
                total += weight
            state = self._move(state, word)
        return total

    def may_match(self, words: set[str]) -> bool:
        if not self.whole.keys().isdisjoint(words) or not THREATS.isdisjoint(words):
            return True
        return any(table and not table.keys().isdisjoint([w[:n] for w in words if len(w) > n]) for n, table in self.begins.items())

    def score(self, text: str | None) -> tuple[float, int]:
        """(probability, clauses with a match) of a whole text."""
        total, clauses = 0.0, 0
        if text:
            text = text.lower()
            if self.may_match(set(_words.findall(text))):
                for clause in _clauses.finditer(text):
                    value = self.clause(_tokens.findall(clause.group()))
                    if value:
                        total += value
                        clauses += 1
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + total)))), clauses


def _terms(text: str | None) -> set[str]:
    words = {w for w in set(_words.findall((text or "").lower())) if 3 <= len(w) <= 24}
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], float]:
    """(patterns with weights, log odds of a text without a match) from labelled rows.

    ``labels`` holds the rows that may be learned from. Of each label a bounded
    number is drawn by a hash of the key; documents are counted once per pattern. A
    beginning is preferred to longer patterns it covers. Without labels of both
    kinds nothing is learned.
    """
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("id"), (F.col(label) > 0).alias("toxic")).distinct()
    counts = {row["toxic"]: row["n"] for row in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(True) or not counts.get(False):
        return {}, math.log((counts.get(True, 0) + 1) / (counts.get(False, 0) + 1))
    draw = F.xxhash64(F.lit("toxicity"), "id").cast("double") / F.lit(2.0**64) + 0.5
    share = F.when(F.col("toxic"), F.lit(SAMPLE_TOXIC / counts[True])).otherwise(F.lit(SAMPLE_CLEAN / counts[False]))
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(marked.where(draw < share)), "id")
    sample = sample.select("text", "toxic").distinct()  # copies of a text are no further evidence

    def count(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            rows = [0, 0]
            for one, bad in zip(batch.column(0), batch.column(1)):
                bad = bad.as_py()
                rows[not bad] += 1
                (toxic if bad else clean).update(_terms(one.as_py()))
            terms = ["", *(toxic.keys() | clean.keys())]  # the empty term counts rows
            toxic[""], clean[""] = rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())],
                ["term", "toxic", "clean"],
            )

    found = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * min(SAMPLE_TOXIC, counts[True])))
    rows = found.where((F.col("term") == "") | ((F.col("toxic") >= least) & (F.col("toxic") > F.col("clean")))).orderBy(F.desc("toxic"), "term").limit(MOST_PATTERNS).collect()
    table = {row["term"]: (row["toxic"], row["clean"]) for row in rows}
    bad, good = table.pop("", (0, 0))
    patterns: dict[str, float] = {}
    for term in sorted(table, key=lambda t: (not t.endswith("*"), len(t), t)):
        hits, misses = table[term]
        ratio = ((hits + 0.5) / (bad + 1)) / ((misses + 0.5) / (good + 1))
        if ratio < LEAST_RATIO or any(term[:n] + "*" in patterns for n in BEGINNINGS if n < len(term.rstrip("*"))):
            continue
        patterns[term] = min(MOST_WEIGHT, math.log(ratio))
    grammar = Grammar(patterns, 0.0)

    def silent(batches):
        for batch in batches:
            rows = [0, 0]
            for one, bad in zip(batch.column(0), batch.column(1)):
                rows[not bad.as_py()] += grammar.score(one.as_py())[1] == 0
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]]), pa.array([rows[1]])], ["toxic", "clean"])

    left = sample.select("text", "toxic").mapInArrow(silent, "toxic long, clean long").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    # the sample's labels are drawn at different rates
    odds = ((left["toxic"] or 0) + 1) * max(1.0, counts[True] / SAMPLE_TOXIC) / (((left["clean"] or 0) + 1) * max(1.0, counts[False] / SAMPLE_CLEAN))
    return patterns, math.log(odds)


def judge(docs: DataFrame, patterns: dict[str, float], bias: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, n_clauses) of every row; null and empty texts score as texts without a match.

    Repeated rows score alike. The patterns (MOST_PATTERNS at most) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((patterns, bias))

    def run(batches):
        grammar = Grammar(*shared.value)
        for batch in batches:
            out = [grammar.score(one.as_py()) for one in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int64())], ["id", "score", "n_clauses"]
            )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, n_clauses long")
