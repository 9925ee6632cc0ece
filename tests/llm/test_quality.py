"""Counts against plain Python; the estimates against numpy; verdicts on planted outliers."""

import random
import re
from collections import Counter

import numpy as np
from text_tables import table

from tidemark.llm import quality

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def clean(k):
    draw = random.Random(k)
    return "\n".join(" ".join(draw.choice(WORDS) + draw.choice(WORDS)[:2] for _ in range(12)).capitalize() + "." for _ in range(draw.randint(6, 14)))


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = Counter(zip(words, words[1:], words[2:])), set()
    for k in range(len(words) - 2):
        if seen[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


AWKWARD = [
    (900, None), (901, ""), (902, " \n \t\n"), (903, "a b c a b c"), (904, "x x x x x"), (905, "l 1\nl 1\n\nl 1\n l 1"), (906, "a\x0bb\x0cc\xa0d 　e #|<> **"), (907, "one two"),
    (908, "a b c d a b c"), (909, "p q r " * 20000), (910, clean(1)), (910, clean(1)), (911, "🙂 é \r\n x"),
]


def test_counts(spark):
    got = quality.with_counts(table(spark, AWKWARD)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for row in got:
        assert tuple(row[n] for n in names) == counts(row["text"]), row["doc_id"]


def test_verdicts(spark):
    rows = [(k, clean(k), ["en", "de", None][k % 3], f"s{k % 2}") for k in range(400)]
    bad = [
        (1000, " ".join(w + "$$$" for w in clean(1).split()), "en", "s0"), (1001, clean(2).upper(), "de", "s1"), (1002, (clean(3) + "\n") * 4, "en", "s1"),
        (1003, " | ".join(clean(4).split()), None, "s0"), (1004, "too short", "en", "s0"), (1005, clean(5).upper(), "rare", "rare"),
    ]
    docs = table(spark, rows + bad, ["group", "distance"])
    got = {r["id"]: r for r in quality.judge(docs).collect()}
    assert all(got[k]["kept"] for k in range(400))
    assert not any(got[r[0]]["kept"] for r in bad)
    assert got[1004]["base_failed"] and got[1004]["distance"] is None
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(400))
    again = {r["id"]: r["distance"] for r in quality.judge(docs.repartition(5)).collect()}
    assert again == {k: r["distance"] for k, r in got.items()}


def test_fit_is_mean_and_cholesky_factor(spark):
    draw = np.random.default_rng(2)
    data = np.round(draw.multivariate_normal(np.arange(5), np.eye(5) + 0.4, 500) * quality.UNIT).astype(int)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in data], ["group", *quality._STATS])
    fit = quality._fit(rows).first()
    values = data / quality.UNIT
    factor = np.linalg.cholesky(np.cov(values.T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2))
    assert np.allclose([fit[f"m{i}"] for i in range(5)], values.mean(0))
    assert all(np.isclose(fit[f"l{i}{j}"], factor[i, j]) for i in range(5) for j in range(i + 1))


def test_estimate_ignores_a_fifth_of_outliers(spark):
    draw = np.random.default_rng(3)
    good, far = draw.normal(0, 0.5, (400, 5)), draw.normal(6, 0.2, (90, 5))
    data = np.round(np.concatenate([good, far]) * quality.UNIT).astype(int)
    rows = spark.createDataFrame([("en", "s", *map(int, r)) for r in data], ["lang", "source", *quality._STATS])
    for fit in quality.estimates(rows).collect():
        assert max(abs(fit[f"m{i}"]) for i in range(5)) < 0.15


def outliers():
    """A text for each statistic that passes the base rule and is far off in that one alone."""
    draw = random.Random(77)
    word = lambda: draw.choice(WORDS) + draw.choice(WORDS)[:2]
    lines = lambda words: "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, len(words), 12))
    few = [WORDS[i] + WORDS[-i][:2] for i in range(20)]
    menu = "\n".join(w.capitalize() if i % 12 == 0 else w for i, w in enumerate(few[draw.randrange(20)] for _ in range(300)))
    again, fresh = [word() for _ in range(70)], [word() for _ in range(170)]
    return {
        2000: lines([word() + word() for _ in range(120)]),
        2001: lines([word() + ("&" if i % 2 else "") for i in range(120)]),
        2002: menu,
        2003: lines(again + fresh[:85] + again + fresh[85:]),
        2004: lines([word() for _ in range(120)]).upper(),
    }


def test_each_statistic_alone_rejects(spark):
    rows = [(k, clean(k)) for k in range(400)] + list(outliers().items())
    # one repeated line of few is no fault
    rows += [(3000 + k, clean(500 + k) + "\n" + clean(500 + k).split("\n")[0]) for k in range(20)]
    got = {r["id"]: r for r in quality.judge(table(spark, rows)).collect()}
    for k in outliers():
        assert not got[k]["base_failed"] and not got[k]["kept"], k
    assert all(r["kept"] for k, r in got.items() if k not in outliers())
    assert got[2002]["n_dup_lines"] > 0.85 * 300 and got[2003]["n_dup_lines"] == 0 < 0.3 * got[2003]["n_words"] < got[2003]["n_repeat_words"]


def test_noise_is_added_to_the_covariance(spark):
    """Distance of every row against numpy, with the fitted estimates."""
    rows = [(k, clean(k)) for k in range(100)] + list(outliers().items())
    docs = table(spark, rows)
    counted = quality.with_counts(docs)
    fit = quality.estimates(counted.select("lang", "source", *quality._vector())).where("group like '%\"level\":0%'").first()
    k = range(5)
    factor = np.array([[fit[f"l{i}{j}"] if j <= i else 0.0 for j in k] for i in k])
    got = {r["id"]: r["distance"] for r in quality.judge(docs).collect()}
    for row in counted.select("doc_id", "n_words", "n_lines", *quality._vector()).collect():
        off = np.array([row[f"x{i}"] / quality.UNIT - fit[f"m{i}"] for i in k])
        noise = np.diag([0, 0, 1 / (4 * row["n_lines"]), quality.LEAST_COVER / (4 * row["n_words"]), 0])
        assert np.isclose(got[row["doc_id"]], off @ np.linalg.solve(fit["scale"] * factor @ factor.T + noise, off))


def test_empty(spark):
    assert quality.judge(table(spark, [])).count() == 0
    assert quality.keep_good(table(spark, [(1, None), (2, "short")])).count() == 0


def test_filter_on_the_verdict_stays_small(spark, folder):
    """The optimizer puts the verdict's definition in the filter's place; it must not multiply there."""
    kept = quality.keep_good(spark.read.parquet(f"{folder}/documents.parquet"))
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 100_000
