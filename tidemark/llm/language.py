"""Language identification by compression.

For each language a sample of labelled text becomes a zstandard raw-content
dictionary. A text belongs to the language whose dictionary compresses it
smallest; if the runner-up is close, the verdict is rejected. Texts are taken in
pieces no longer than the dictionary helps, whole texts always, and the sizes are
added up.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that form a language's sample, about; characters of each; bytes of the dictionary.
SAMPLE_ROWS = 160
SAMPLE_CHARS = 1000
DICT_BYTES = 32 << 10
#: Bytes compressed at once.
PIECE_BYTES = 8 << 10
#: Short matches tell languages apart, so matching starts at four bytes.
SETTINGS = {"window_log": 16, "hash_log": 15, "chain_log": 15, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY}
#: A verdict holds if the runner-up needs this many bytes more per 1000, and this many at least.
LEAST_SHARE = 10
LEAST_BYTES = 2
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}")


def learn(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, tuple[int, bytes]]:
    """Rows and dictionary content of each language, the latter from about ``SAMPLE_ROWS`` labelled rows of each.

    Rows are drawn by a hash of their key, so reruns draw the same. The sample is
    bounded by SAMPLE_ROWS and SAMPLE_CHARS whatever the table's size; only counts
    by language are taken over all rows.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("language"), F.col(key)).alias("draw"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows_of = {row["lang"]: row["n"] for row in counts.collect()}  # one row a language
    if not rows_of:
        return {}
    # the hash is even over its range: a share of the range is about that share of the rows
    share = reduce(lambda so_far, name: so_far.when(F.col("lang") == name, F.lit(SAMPLE_ROWS / rows_of[name])), rows_of, F.when(F.lit(False), F.lit(0.0)))
    drawn = rows.where(F.col("draw").cast("double") / F.lit(2.0**64) + 0.5 <= share)
    sample: dict[str, list[tuple[int, str]]] = {}
    for row in drawn.select("lang", "draw", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect():
        sample.setdefault(row["lang"], []).append((row["draw"], row["text"]))
    made = {}
    for name in sorted(sample):
        content = "\n".join(text.lower() for _, text in sorted(sample[name])).encode("utf-8", "replace")
        made[name] = rows_of[name], content[-DICT_BYTES:]
    return made


class Classifier:
    def __init__(self, dictionaries: dict[str, tuple[int, bytes]]):
        # the more frequent language wins a tie
        self.names = sorted(dictionaries, key=lambda name: (-dictionaries[name][0], name))
        self.encoders = []
        settings = zstandard.ZstdCompressionParameters(**SETTINGS, write_checksum=0, write_content_size=0, write_dict_id=0)
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name][1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum(len(encoder.compress(piece)) for piece in pieces) for encoder in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool, int]:
        """(language, score, accepted, runner-up's additional bytes)."""
        if not text or not self.names or not _letter.search(text):
            return UNKNOWN, 0.0, False, 0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        more = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best]) - sizes[best]
        # two codes' lengths in bits are log likelihoods; the cap keeps the score below 1
        score = 1 / (1 + sum(2.0 ** -min(60, s - sizes[best]) for i, s in enumerate(sizes) if i != best))
        return self.names[best], score, more >= LEAST_BYTES and 1000 * more >= LEAST_SHARE * sizes[best], more


def identify(docs: DataFrame, dictionaries: dict[str, tuple[int, bytes]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, margin) of every row.

    Null, empty and letterless texts are ``und`` with score 0, not accepted; so is
    every text if no language was learned. Ties go to the language with more labelled
    rows and are not accepted. Repeated rows are judged alike. The dictionaries (DICT_BYTES
    each) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        classifier = Classifier(shared.value)
        for batch in batches:
            out = [classifier.predict(one.as_py()) for one in batch.column(1)]
            names, scores, accepted, margins = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_()), pa.array(margins, pa.int64())],
                ["id", "lang_pred", "score", "accepted", "margin"],
            )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean, margin long")
