"""Exact ranks, quantiles and positions against pandas, with ties and hot values."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_enough, days, pandas_sorted
from pyspark.sql import functions as F

from tidemark.operators import ordering, stats


@pytest.fixture(params=["8", "300"])
def width(request, spark):
    """Shuffle widths with one and with two splitting levels."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def sample(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    value = rng.normal(size=n)
    value[: n // 3] = 0.25  # one value holds a third of all rows
    return pd.DataFrame({"k": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "value": value})


def test_average_ranks(spark, width):
    data = sample()
    data["other"] = data.value.sample(frac=1, random_state=1).to_numpy()
    data["id"] = range(len(data))
    got = pandas_sorted(
        ordering.with_ranks(spark.createDataFrame(data), ["k"], {"value": "r1", "other": "r2"}, salt="id"), "id"
    )
    groups = data.groupby("k")
    assert close_enough(got.r1, groups.value.rank(), 1e-12) and close_enough(got.r2, groups.other.rank(), 1e-12)


def test_quantiles_and_medians(spark, width):
    data = sample(801, 1)
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = ordering.quantiles(spark.createDataFrame(data), ["k"], "value", at).toPandas()
    for (k, q), v in got.set_index(["k", "q"])["quantile"].items():
        assert v == pytest.approx(np.quantile(data[data.k == k].value, q), abs=1e-12)
    assert len(got) == 2 * len(at)


def test_quantiles_of_tiny_groups(spark):
    data = spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)], "k string, value double")
    got = {r.k: r.median for r in ordering.medians(data, ["k"], "value").collect()}
    assert got == {"one": 3.0, "two": 1.5}


def test_global_ranks(spark, width):
    data = spark.createDataFrame([(float(i % 250),) for i in range(500)], "v double")
    got = pandas_sorted(ordering.with_ranks(data, [], {"v": "r"}), "v")
    assert close_enough(got.r, got.v.rank(), 0)


def test_ordinals_break_ties_by_date_then_name(spark, width):
    rng = np.random.default_rng(2)
    n = 600
    data = pd.DataFrame(
        {
            "model": "m",
            "probability": rng.choice([0.5, 0.5, 0.5, *rng.random(20)], n),
            "market_date": [days("2024-01-01", 60)[i % 60] for i in range(n)],
            "symbol": [f"s{i // 60}" for i in range(n)],
        }
    )
    got = ordering.ordinals(spark.createDataFrame(data), ["model"], "probability", "market_date", "symbol").toPandas()
    got = got.sort_values("ordinal").reset_index(drop=True)
    want = data.sort_values(["probability", "market_date", "symbol"]).reset_index(drop=True)
    assert got.ordinal.tolist() == list(range(1, n + 1))
    assert (got[["probability", "market_date", "symbol"]] == want[["probability", "market_date", "symbol"]]).all().all()


def test_quintile_sizes_of_737_rows(spark):
    """Right-closed cuts of the percentile rank: not the sizes ``ntile`` gives."""
    rows = [("m", i / 737, days("2023-01-01", 1)[0], f"s{i:04d}") for i in range(737)]
    data = spark.createDataFrame(rows, "model string, probability double, market_date date, symbol string")
    sizes = {r.probability_bucket: r["count"] for r in stats.with_quintile(data).groupBy("probability_bucket").count().collect()}
    assert [sizes[q] for q in stats.QUINTILE_LABELS] == [147, 147, 148, 147, 148]


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 1)
    y = (rng.random(400) < p).astype(int)
    data = spark.createDataFrame(pd.DataFrame({"model": "m", "probability": p, "actual_up": y}))
    got = stats.roc_auc(data, ["model"]).first().roc_auc
    up, down = p[y == 1][:, None], p[y == 0][None, :]
    want = ((up > down).mean() + 0.5 * (up == down).mean())
    assert got == pytest.approx(want, abs=1e-12)
    one_class = data.withColumn("actual_up", F.lit(1))
    assert stats.roc_auc(one_class, ["model"]).first().roc_auc is None
