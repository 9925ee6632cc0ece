"""Moment matrices and elimination against numpy; folds as pruned ranges."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, linear, models
from tidemark.plans import panels


def matrix(spark, values, **more):
    return spark.createDataFrame([(values.tolist(), *more.values())], "m array<array<double>>" + "".join(f", {k} array<double>" for k in more))


@pytest.mark.parametrize("n", [1, 2, 7, 43])
def test_solution_and_inverse(spark, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(3 * n, n))
    m, y = a.T @ a + np.eye(n), rng.normal(size=n)
    got = matrix(spark, m, y=y.tolist()).select(linear.solution(F.col("m"), F.col("y")).alias("x"), linear.inverse_diagonal(F.col("m")).alias("d")).first()
    assert got["x"] == pytest.approx(np.linalg.solve(m, y).tolist())
    assert got["d"] == pytest.approx(np.diag(np.linalg.inv(m)).tolist())


def test_picked(spark):
    m = np.arange(16.0).reshape(4, 4)
    frame = matrix(spark, m).withColumn("p", F.array(F.lit(3), F.lit(1)))
    got = frame.select(linear.picked(F.col("m"), F.col("p"), F.array(F.lit(10.0), F.lit(0.5))).alias("x")).first()["x"]
    assert got == [[m[2, 2] + 10, m[2, 0]], [m[0, 2], m[0, 0] + 0.5]]


def test_moments_are_sums_of_a_group(spark):
    rng = np.random.default_rng(5)
    z, g = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(f"g{k}", *map(float, v)) for k, v in zip(g, z)], "of string, a double, b double, c double").repartition(7)
    got = {r["of"]: r["moments"] for r in linear.moments(rows, "of", ["a", "b", "c"]).collect()}
    assert set(got) == {"g0", "g1"}
    for k in (0, 1):
        assert np.allclose(got[f"g{k}"], z[g == k].T @ z[g == k])
    named = linear.moments(rows, "of", ["a"], lambda group, x: {"n": np.full((1, 2), len(x)), "s": x.T @ x})
    assert {(r["of"], r["name"]): len(r["moments"][0]) for r in named.collect()} == {(f"g{k}", n): w for k in (0, 1) for n, w in (("n", 2), ("s", 1))}
    assert linear.moments(rows.filter("a > 99"), "of", ["a", "b", "c"]).isEmpty()


def test_newton_gives_up_with_an_error(spark, monkeypatch):
    monkeypatch.setattr(models, "NEWTON_STEPS", 1)
    rows = [("f", "train", float(i % 2), float(i)) for i in range(10)]
    tagged = spark.createDataFrame(rows, "fold string, role string, up double, a double")
    scalings = models.fold_scalings(tagged, ["a"], "up")
    with pytest.raises(ArithmeticError, match="Newton"):
        models.fit_logistic(tagged, {"m": ("a",)}, scalings, "up")


def test_each_fold_reads_its_own_years(spark, folder):
    """One scan a (fold, role), pruned to the range's years; a filter on both leaves one."""

    def plan(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        return out.getvalue()

    tagged = panels.tagged(spark, folder)
    whole = plan(tagged.select("fold", "role", "close"))
    assert whole.count("PartitionFilters: [isnotnull(market_year") == 2 * len(panels.FOLDS)
    one = plan(tagged.filter("fold = 'fold_2' and role = 'validation'").select("close"))
    assert one.count("PartitionFilters") == 1 and "market_year" in one and "Generate" not in one
    years = {r[0] for r in tagged.filter("fold = 'fold_2' and role = 'validation'").select(F.year("market_date")).distinct().collect()}
    assert years == {1999} and folds.YEAR not in tagged.columns
