"""Held-out accuracy and the cases without a verdict."""

import random

from pyspark.sql import functions as F
from text_tables import table

from tidemark.llm import language

SYLLABLES = {"xx": "ba be bi bo bu da de".split(), "yy": "ska sle smi sno spu".split(), "zz": "ümi öra änu ßel".split()}


def text(lang, n, draw):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))


def corpus(n=120):
    draw = random.Random(1)
    return [(k, text(lang, draw.randint(5, 80), draw), lang, "s") for k, lang in enumerate(draw.choices("xyz", k=n)) for lang in [lang * 2]]


def test_accuracy(spark):
    docs = table(spark, corpus(), ["lang_pred", "score"])
    known = language.learn(docs, F.col("doc_id") % 4 != 2)
    assert set(known) == {"xx", "yy", "zz"} and all(len(content) <= language.DICT_BYTES for _, content in known.values())
    assert known == language.learn(docs, F.col("doc_id") % 4 != 2)
    truth = {r[0]: r[2] for r in corpus()}
    got = [r for r in language.identify(docs, known).collect() if r["id"] % 4 == 2]
    assert sum(r["lang_pred"] == truth[r["id"]] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_awkward_rows(spark):
    docs = table(spark, corpus())
    known = language.learn(docs, F.lit(True))
    rows = [(1, None), (2, ""), (3, "123 !? 9"), (4, "é"), (5, "BA BE BI " * 30000), (6, "ska"), (6, "ska"), (None, "ska smi")]
    got = {(r["id"], r["lang_pred"]): r for r in language.identify(table(spark, rows), known).collect()}
    assert {k for k in got if k[0] in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")}
    assert not any(got[k]["accepted"] or got[k]["score"] for k in got if k[1] == "und")
    assert (5, "xx") in got
    assert all(k[1] in known for k in got if k[0] not in (1, 2, 3))


def test_nothing_learned(spark):
    assert language.learn(table(spark, []), F.lit(True)) == {}
    assert language.learn(table(spark, [(1, "text", None, "s")]), F.lit(True)) == {}
    assert [r["lang_pred"] for r in language.identify(table(spark, [(1, "text")]), {}).collect()] == ["und"]
    assert language.identify(table(spark, []), {}).count() == 0
