"""Rows with NULL keys, dates or probabilities are neither lost nor counted; order statistics hold for many keys and ties."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_enough, day
from pyspark.sql import functions as F

from tidemark.operators import asof, ordering, panel, recurrence, stats


def test_row_index_keeps_null_keys_and_dates(spark):
    rows = spark.createDataFrame([("a", None), (None, None), (None, day("2020-01-02")), ("a", day("2020-01-01"))], "symbol string, market_date date")
    got = {(r.symbol, r.market_date, r[panel.ROW]) for r in panel.index_rows(rows).collect()}
    assert got == {("a", None, 0), ("a", day("2020-01-01"), 1), (None, None, 0), (None, day("2020-01-02"), 1)}


def test_both_asof_strategies_keep_rows_without_key_or_date(spark):
    left = spark.createDataFrame([("a", day("2020-01-03")), ("a", None), (None, day("2020-01-03"))], "symbol string, day date")
    right = spark.createDataFrame([("a", day("2020-01-01"), 1.0), (None, day("2020-01-01"), 9.0), ("a", None, 8.0)], "symbol string, seen date, v double")
    got = {(r.symbol, r.day): r.v for r in asof.join_by_key(left, right, ["symbol"], "day", "seen", ["v"]).collect()}
    assert got == {("a", day("2020-01-03")): 1.0, ("a", None): None, (None, day("2020-01-03")): None}
    assert asof.join_by_calendar(left, right.filter("symbol = 'a'").drop("symbol"), "day", "seen", ["v"]).count() == 3


def test_no_bucket_and_no_rank_without_probability(spark):
    rows = [("m", day("2020-01-01") + pd.Timedelta(days=i), "s", float(i) if i % 2 else None, int(i % 3 == 0)) for i in range(100)]
    data = spark.createDataFrame([(m, pd.Timestamp(d).date(), s, p, y) for m, d, s, p, y in rows], "model string, market_date date, symbol string, probability double, actual_up int")
    got = stats.with_quintile(data).toPandas()
    assert len(got) == 100 and got.probability_bucket.isna().sum() == 50
    assert got[got.probability.isna()].probability_bucket.isna().all()
    assert sorted(got.probability_bucket.value_counts()) == [10] * 5
    known = got.dropna(subset=["probability"])
    up, down = known[known.actual_up == 1].probability, known[known.actual_up == 0].probability
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
    assert stats.roc_auc(data, ["model"]).first().roc_auc == pytest.approx(wins)


@pytest.mark.parametrize("width", ["4", "60"])
def test_ranks_of_many_keys_with_heavy_ties(spark, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        rng = np.random.default_rng(7)
        data = pd.DataFrame({"k": rng.integers(0, 130, 20_000), "v": np.round(rng.normal(size=20_000), 1), "id": range(20_000)})
        data.loc[::3, "v"] = 0.5
        df = spark.createDataFrame(data)
        got = ordering.with_ranks(df.repartition(7), ["k"], {"v": "r"}, salt="id").toPandas().sort_values("id")
        assert len(got) == len(data)
        assert close_enough(got.r.reset_index(drop=True), data.groupby("k").v.rank(), 1e-12)
        sizes = ordering._piece_sizes(ordering.with_pieces(df, ["k"], ["v"]), ["k"], "v").groupBy("k").agg(F.sum("_in_piece").alias("n")).toPandas()
        assert dict(zip(sizes.k, sizes.n)) == data.k.value_counts().to_dict()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("rows", [1024, 100, 7])
def test_smoothing_equals_pandas_for_any_weight(spark, rows):
    n = 6000
    x = pd.Series(100 + np.random.default_rng(0).normal(size=n).cumsum())
    data = spark.createDataFrame(pd.DataFrame({"symbol": "a", "market_date": pd.date_range("2000-01-01", periods=n).date, "x": x}))
    alphas = (0.0004, 0.01, 0.22, 0.6, 0.9, 1.0)
    frame = panel.spread(panel.index_rows(data), rows=rows)
    got = recurrence.smooth(frame, [recurrence.Smooth(f"y{i}", "x", a) for i, a in enumerate(alphas)], rows=rows)
    out = got.filter(panel.is_home(rows)).orderBy("market_date").toPandas()
    for i, a in enumerate(alphas):
        assert close_enough(out[f"y{i}"], x.ewm(alpha=a, adjust=False).mean(), 1e-9)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from tidemark import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_tail_probabilities_keep_relative_precision(spark):
    import math

    from tidemark.functions.scalars import two_sided_normal_p

    at = [0.0, 0.5, 1.96, 2.999, 3.0, 5.0, 8.0, 12.0, 30.0, -9.0]
    rows = spark.createDataFrame([(x,) for x in [*at, None]], "t double").select("t", two_sided_normal_p(F.col("t")).alias("p")).collect()
    for row in rows:
        assert (row.p is None) if row.t is None else row.p == pytest.approx(math.erfc(abs(row.t) / math.sqrt(2)), rel=1e-9)
