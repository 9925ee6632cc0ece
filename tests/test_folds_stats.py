"""Purged folds, summaries, correlations and HAC inference against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from helpers import close_enough, day, days, pandas_sorted
from pyspark.sql import functions as F

from tidemark.functions.scalars import correlation, two_sided_normal_p
from tidemark.operators import checks, folds, stats

PANEL = "symbol string, market_date date, close double"


def business(spark, start, end):
    dates = [d.date() for d in pd.bdate_range(start, end)]
    rows = [(s, d, float(i)) for s in ("X", "Y") for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, PANEL), dates


def test_target_end_is_five_rows_ahead(spark):
    data, dates = business(spark, "2025-12-15", "2026-01-15")
    got = pandas_sorted(folds.with_target_end(data, 5), "symbol", "market_date")
    one = got[got.symbol == "X"]
    assert one.target_end_date.tolist()[:-5] == dates[5:] and one.target_end_date.isna().sum() == 5
    with pytest.raises(checks.DataCheckError):
        folds.with_target_end(data, 0)


def test_purged_range_drops_crossing_targets(spark):
    data, dates = business(spark, "2025-12-15", "2026-01-15")
    got = folds.purged_range(folds.with_target_end(data, 5), "2025-12-15", "2025-12-31").toPandas()
    inside = [d for d in dates if d <= day("2025-12-31")]
    assert sorted(set(got.market_date)) == inside[:-5]
    with pytest.raises(checks.DataCheckError):
        folds.purged_range(data, "2026-01-01", "2025-01-01")


def test_default_folds(spark):
    data, dates = business(spark, "2021-10-04", "2025-12-31")
    tagged = folds.assign_folds(folds.with_target_end(data, 5)).toPandas()
    assert set(tagged.fold) == {"fold_1", "fold_2", "fold_3"}
    for fold, year in (("fold_1", 2023), ("fold_2", 2024), ("fold_3", 2025)):
        train = tagged[(tagged.fold == fold) & (tagged.role == "train")]
        valid = tagged[(tagged.fold == fold) & (tagged.role == "validation")]
        assert train.target_end_date.max() <= day(f"{year - 1}-12-31") < valid.market_date.min()
        assert {d.year for d in valid.market_date} == {year} and valid.target_end_date.max().year == year
        assert train.market_date.min() == day("2021-10-04")
    assert not any(d.year == 2026 for d in tagged.target_end_date)
    with pytest.raises(checks.DataCheckError):
        folds.assign_folds(data, [("f", "2021-01-01", "2022-06-30", "2022-06-01", "2022-12-31")])


def test_splits(spark):
    data, dates = business(spark, "2025-12-29", "2026-01-05")
    roles = {r.market_date: r.role for r in folds.chronological_split(data, "2026-01-01").collect()}
    assert roles[day("2025-12-31")] == "development" and roles[day("2026-01-01")] == "test"
    ended = folds.purged_development(folds.with_target_end(data, 1), "2025-12-31")
    assert ended.agg(F.max("market_date")).first()[0] == day("2025-12-30")
    assert checks.holdout_rows(ended, 2026, ["market_date", "target_end_date"]).isEmpty()


def test_score_summary(spark):
    rows = [(1, 0.02), (1, -0.01), (1, None), (2, 0.05)]
    data = spark.createDataFrame(rows, "directional_score int, forward_return_1 double")
    got = {r.directional_score: r for r in stats.score_summary(data, horizons=(1,)).collect()}
    one, two = got[1], got[2]
    assert (one.observations, one.n_1, one.positive_rate_1) == (3, 2, 0.5)
    error = np.std([0.02, -0.01], ddof=1) / math.sqrt(2)
    assert one.se_return_1 == pytest.approx(error) and one.ci95_low_1 == pytest.approx(0.005 - 1.96 * error)
    assert two.median_return_1 == 0.05 and two.se_return_1 is None and two.ci95_high_1 is None


def test_regime_summary_and_excess(spark):
    rows = [("a", 0.01), ("a", 0.03), ("b", -0.04), ("unclassified", None)]
    data = spark.createDataFrame(rows, "treasury_regime string, forward_return_5 double")
    summary = stats.regime_summary(data, horizons=(5,))
    got = {r.treasury_regime: r for r in stats.with_excess(summary, stats.unconditional_baseline(data, (5,)), (5,)).collect()}
    assert got["a"].mean_return_5d == pytest.approx(0.02) and got["a"].excess_return_5d == pytest.approx(0.02)
    assert got["unclassified"].positive_rate_5d is None and got["unclassified"].n_5d == 0
    starts = stats.episode_summary(data, horizons=(5,)).toPandas()
    assert set(starts.treasury_regime) == {"a", "b"}


def test_relationships_rank_inside_complete_pairs(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"f": np.round(rng.normal(size=300), 1), "g": rng.normal(size=300), "flat": 1.0, "t": rng.normal(size=300)})
    data.loc[::7, "f"] = None
    got = stats.relationships(spark.createDataFrame(data), ["f", "g", "flat"], ["t"]).toPandas().set_index("feature")
    for c in ("f", "g"):
        both = data[[c, "t"]].dropna()
        assert got.pearson[c] == pytest.approx(both[c].corr(both.t)) and got.observations[c] == len(both)
        ranks = both.rank()
        assert got.spearman[c] == pytest.approx(ranks[c].corr(ranks.t))
    assert pd.isna(got.pearson["flat"]) and pd.isna(got.spearman["flat"])
    few = spark.createDataFrame(data[:2])
    assert stats.relationships(few, ["g"], ["t"]).count() == 0
    assert stats.event_correlations(spark.createDataFrame(data), ["f"], "t").first().unique_feature_values == data.f.nunique()


def test_describe_and_matrix(spark):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"a": rng.normal(size=101), "b": rng.normal(size=101)})
    got = stats.describe_columns(spark.createDataFrame(data), ["a", "b"]).toPandas().set_index("feature")
    want = data.describe().T
    for name, column in (("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("mean", "mean"), ("std", "std")):
        assert close_enough(got[name].sort_index(), want[column].sort_index(), 1e-12)
    matrix = stats.correlation_matrix(spark.createDataFrame(data), ["a", "b"]).toPandas()
    assert len(matrix) == 4 and matrix[matrix.row == matrix.column].pearson.tolist() == pytest.approx([1, 1])


def test_correlation_of_a_constant_is_null(spark):
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one.agg(correlation("x", "y").alias("r")).first().r is None


def test_calibration_edges(spark):
    rows = [("m", p, 1, 0.1) for p in (0.0, 0.1, 0.10000001, 0.95, 1.0)]
    data = spark.createDataFrame(rows, "model string, probability double, actual_up int, forward_return_5 double")
    got = {r.calibration_bucket: r.observations for r in stats.calibration(data).collect()}
    assert got == {"(-0.001, 0.1]": 2, "(0.1, 0.2]": 1, "(0.9, 1.0]": 2}


def test_metrics(spark):
    y, p = np.array([0.1, -0.2, 0.3, 0.0]), np.array([0.2, 0.1, 0.1, 0.0])
    data = spark.createDataFrame(pd.DataFrame({"fold": "f", "model": "m", "actual": y, "prediction": p}))
    row = stats.regression_metrics(data).first()
    assert row.mae == pytest.approx(np.abs(y - p).mean()) and row.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.directional_accuracy == pytest.approx(0.75)
    zero = stats.regression_metrics(data.withColumn("prediction", F.lit(0.0))).first()
    assert zero.directional_accuracy is None
    labels, prob = [1, 0, 1, 0], [0.9, 0.5, 0.4, 0.1]
    data = spark.createDataFrame(pd.DataFrame({"fold": "f", "model": "m", "actual_up": labels, "probability": prob}))
    row = stats.classification_metrics(data).first()
    assert (row.roc_auc, row.accuracy, row.balanced_accuracy) == (0.75, 0.5, 0.5)
    assert row.log_loss == pytest.approx(-np.mean(np.log([0.9, 0.5, 0.4, 0.9])))


def newey_west(y, d, lags):
    """Textbook sandwich, no small-sample factor."""
    X = np.column_stack([np.ones(len(y)), d])
    bread = np.linalg.inv(X.T @ X)
    beta = bread @ X.T @ y
    u = X * (y - X @ beta)[:, None]
    meat = u.T @ u
    for l in range(1, lags + 1):
        g = u[l:].T @ u[:-l]
        meat += (1 - l / (lags + 1)) * (g + g.T)
    return beta[1], math.sqrt((bread @ meat @ bread)[1, 1])


def test_hac_equals_the_textbook_sandwich(spark):
    rng = np.random.default_rng(8)
    n = 1300  # more than one block
    data = pd.DataFrame({"symbol": "X", "market_date": days("2020-01-01", n), "treasury_regime": rng.choice(["a", "b", "unclassified"], n)})
    for h in (1, 5):
        data[f"forward_return_{h}"] = 0.01 + rng.normal(size=n).cumsum() * 0.01
        data.loc[n - h:, f"forward_return_{h}"] = None
    got = stats.hac_regime_effects(spark.createDataFrame(data), horizons=(1, 5)).toPandas().set_index(["treasury_regime", "horizon_days"])
    assert len(got) == 4
    for (regime, h), row in got.iterrows():
        sample = data.dropna(subset=[f"forward_return_{h}"])
        d = (sample.treasury_regime == regime).astype(float).to_numpy()
        beta, se = newey_west(sample[f"forward_return_{h}"].to_numpy(), d, h)
        assert row.coefficient == pytest.approx(beta, rel=1e-9) and row.hac_standard_error == pytest.approx(se, rel=1e-9)
        assert row.p_value == pytest.approx(math.erfc(abs(beta / se) / math.sqrt(2)), abs=1e-12)
        assert row.observations == len(sample) and row.regime_observations == d.sum()


def test_published_p_values(spark):
    """t statistics and p-values as printed in a public report."""
    rows = spark.createDataFrame([(-0.7237567845529174, 0.46921506473267105), (-2.2473916120437396, 0.024615010604620187), (0.0, 1.0), (9.0, 0.0)], "t double, p double")
    for r in rows.select("p", two_sided_normal_p(F.col("t")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-13)


def test_sign_means_and_counts(spark):
    data = spark.createDataFrame([(1.0, 0.1), (2.0, 0.3), (-1.0, -0.2), (0.0, 9.0)], "x double, y double")
    row = stats.sign_conditional_means(data, "x", "y").first()
    assert (row.positive_events, row.negative_events) == (2, 1)
    assert row.mean_after_positive == pytest.approx(0.2) and row.mean_after_negative == -0.2


def test_relationships_with_partial_masks_and_repeated_rows(spark):
    rng = np.random.default_rng(12)
    data = pd.DataFrame({c: np.round(rng.normal(size=240), 1) for c in ("f", "g", "t", "u")})
    data.loc[::5, "f"] = None
    data.loc[::7, "t"] = None
    data.loc[::3, "u"] = None
    data.loc[:60, "g"] = 2.5  # one value holds a quarter of the rows
    data = pd.concat([data, data[:80], data[:80]], ignore_index=True)
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None), "f double, g double, t double, u double")
    got = {(r.feature, r.target): r for r in stats.relationships(frame, ["f", "g"], ["t", "u"]).collect()}
    for f in ("f", "g"):
        for t in ("t", "u"):
            both, r = data[[f, t]].dropna(), got[f, t]
            ranks = both.rank()
            assert r.observations == len(both)
            assert r.pearson == pytest.approx(both[f].corr(both[t])) and r.spearman == pytest.approx(ranks[f].corr(ranks[t]))
    assert stats.relationships(frame.limit(0), ["f"], ["t"]).count() == 0
