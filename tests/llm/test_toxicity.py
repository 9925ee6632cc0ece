"""Learning from labels, clause effects, rows without a verdict."""

import random

import pytest
from text_tables import table

from tidemark.llm import toxicity

PLAIN = "moon river stone window garden paper bread table winter morning letter travel".split()


def corpus(n=400):
    draw = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        bad = k % 6 == 0
        words = [draw.choice(PLAIN) + draw.choice(["", "s", "ing"]) for _ in range(draw.randint(8, 40))]
        if bad:
            for _ in range(draw.randint(1, 3)):
                words.insert(draw.randrange(len(words)), "grmpf" + draw.choice(["o", "el", "ast", "in"]))
        rows.append((k, " ".join(words) + f". x{k}"))
        labels.append((k, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = corpus()
    docs, marks = table(spark, rows, ["toxic"]), spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.learn(docs, marks.where("doc_id % 3 <> 1"))


def test_held_out(spark, learned):
    rows, labels = corpus()
    got = {r["id"]: r["score"] for r in toxicity.judge(table(spark, rows, ["score", "id"]), *learned).collect()}
    held = [(got[k], bad) for k, bad in labels if k % 3 == 1]
    assert all((score >= 0.7) == bool(bad) for score, bad in held)
    assert "grmp*" in learned[0] and not any(p.strip("*") in w for p in learned[0] for w in PLAIN)


def test_clauses():
    grammar = toxicity.Grammar({"idiot": 4.0, "stup*": 4.0}, -5.0)
    value = lambda text: grammar.score(text)[0]
    assert value("you are an idiot") > value("an idiot")
    assert value("it said an idiot") < value("an idiot")
    assert value("not an idiot") < value("an idiot")
    assert value("\"idiot\"") < value("idiot")
    assert value("you stupidly fell") > value("stupidly fell") > value("stup fell")
    assert value("I will kill you") > value("kill the lights") == value("the lights")
    assert value("kill. you") == value("the lights")  # clauses stand apart
    assert grammar.score("an idiot. an idiot! idiot")[1] == 3
    assert grammar.score("not. an idiot")[0] == value("an idiot")


def test_awkward_rows(spark, learned):
    rows = [(1, None), (2, ""), (3, "moon"), (4, "grmpfel " * 30000), (4, "grmpfel " * 30000), (None, "GRMPFEL!")]
    got = toxicity.judge(table(spark, rows), *learned).collect()
    score = {r["id"]: r["score"] for r in got}
    assert len(got) == 6 and score[1] == score[2] == score[3] < 0.5 < score[None] <= score[4] <= 1


def test_nothing_learned(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    patterns, bias = toxicity.learn(table(spark, [(1, "text")]), labels)
    assert patterns == {}
    assert toxicity.judge(table(spark, []), patterns, bias).count() == 0
    only = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.learn(table(spark, [(1, "text")]), only)[0] == {}
