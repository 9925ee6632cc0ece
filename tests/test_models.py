"""Ridge and logistic fits against closed forms; train-only statistics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import catalog
from tidemark.operators import folds, models, stats

FEATURES = {"small_ridge": ("a", "b"), "large_ridge": ("a", "b", "c")}
LOGISTIC = {"small_logistic": ("a", "b"), "large_logistic": ("a", "b", "c")}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    dates = [d.date() for d in pd.bdate_range("2021-10-04", "2025-12-31")]
    n = len(dates)
    frame = pd.DataFrame({"symbol": "X", "market_date": dates, "a": rng.normal(size=n), "b": rng.exponential(size=n), "c": rng.normal(size=n)})
    frame.loc[rng.random(n) < 0.1, "b"] = np.nan
    frame["forward_return_5"] = 0.02 * frame.a - 0.01 * frame.c + rng.normal(0, 0.05, n)
    frame.loc[n - 5:, "forward_return_5"] = np.nan
    frame["change_2y_5d_bp"], frame["change_30y_5d_bp"] = rng.normal(size=n), rng.normal(size=n)
    return frame


@pytest.fixture(scope="module")
def tagged(spark, data):
    rows = models.with_targets(folds.with_target_end(spark.createDataFrame(data), 5))
    return folds.assign_folds(rows).persist()


def design(frame, features, train):
    fill = train[list(features)].median()
    x, t = frame[list(features)].fillna(fill), train[list(features)].fillna(fill)
    return ((x - t.mean()) / t.std(ddof=0)).to_numpy()


def test_ridge_equals_closed_form(spark, tagged):
    scalings = models.fold_scalings(tagged, models.all_features(FEATURES), "forward_return_5")
    fits = models.fit_ridge(tagged, FEATURES, scalings)
    got = models.ridge_predictions(tagged, fits, scalings, FEATURES).toPandas()
    local = tagged.toPandas()
    for fold in ("fold_1", "fold_2", "fold_3"):
        train = local[(local.fold == fold) & (local.role == "train")]
        valid = local[(local.fold == fold) & (local.role == "validation")].sort_values("market_date")
        y = train.forward_return_5.to_numpy()
        for name, features in FEATURES.items():
            x = design(train, features, train)
            w = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (y - y.mean()))
            want = design(valid, features, train) @ w + y.mean()
            mine = got[(got.fold == fold) & (got.model == name)].sort_values("market_date").prediction
            assert np.abs(mine.to_numpy() - want).max() < 1e-9
        naive = got[(got.fold == fold) & (got.model == "naive_mean")].prediction
        assert np.allclose(naive, y.mean())
    metrics = stats.regression_metrics(models.ridge_predictions(tagged, fits, scalings, FEATURES))
    assert metrics.count() == 3 * 4
    assert metrics.filter("model = 'zero_return' and directional_accuracy is not null").isEmpty()


def newton(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.eye(a.shape[1])
    penalty[0, 0] = 0
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    return w


def test_logistic_equals_newton(spark, tagged):
    scalings = models.fold_scalings(tagged, models.all_features(LOGISTIC), "target_up_5d")
    fits = models.fit_logistic(tagged, LOGISTIC, scalings)
    wide = models.logistic_predictions(tagged, fits, scalings, LOGISTIC)
    local, got = tagged.toPandas(), wide.toPandas()
    assert set(got.columns) >= {"base_probability", "small_probability", "large_probability", "actual_up"}
    for fold in ("fold_1", "fold_3"):
        train = local[(local.fold == fold) & (local.role == "train")]
        valid = local[(local.fold == fold) & (local.role == "validation")].sort_values("market_date")
        mine = got[got.fold == fold].sort_values("market_date")
        assert np.allclose(mine.base_probability, train.target_up_5d.mean())
        for name, features in LOGISTIC.items():
            w = newton(design(train, features, train), train.target_up_5d.to_numpy())
            want = 1 / (1 + np.exp(-(w[0] + design(valid, features, train) @ w[1:])))
            assert np.abs(mine[name.replace("_logistic", "_probability")].to_numpy() - want).max() < 1e-5
    metrics = stats.classification_metrics(models.long_predictions(wide, LOGISTIC)).toPandas()
    assert len(metrics) == 9 and (metrics[metrics.model == "base_rate"].roc_auc == 0.5).all()


def test_statistics_come_from_train_rows_only(spark, data, tagged):
    """Changing validation rows leaves the fold's statistics unchanged."""
    before = models.fold_scalings(tagged, ["a", "b"], "forward_return_5")["fold_1"]
    moved = tagged.withColumn("a", F.when(F.col("role") == "validation", F.col("a") + 100).otherwise(F.col("a")))
    after = models.fold_scalings(moved, ["a", "b"], "forward_return_5")["fold_1"]
    assert before == after


def test_feature_without_train_values_is_left_out(spark, tagged):
    hollow = tagged.withColumn("b", F.lit(None).cast("double"))
    scaling = models.fold_scalings(hollow, ["a", "b"], "forward_return_5")["fold_1"]
    assert scaling.usable(["a", "b"]) == ["a"]


def test_frozen_feature_sets():
    assert len(catalog.TECHNICAL_FEATURES) == 17 and len(catalog.RESEARCH_TECHNICAL_FEATURES) == 18
    assert len(catalog.TREASURY_FEATURES) == 26 and len(set(catalog.TREASURY_FEATURES)) == 26
    assert [len(f) for f in catalog.LOGISTIC_MODELS.values()] == [5, 8, 13, 9, 14, 9, 14]
    assert [len(f) for f in catalog.RIDGE_MODELS.values()] == [17, 26, 43, 5, 8, 13]
    assert not set(catalog.PAYROLL_RESEARCH_ONLY) & {f for fs in catalog.PAYROLL_CANDIDATES.values() for f in fs}
    assert catalog.LOCKED_YEAR not in catalog.VALIDATION_YEARS
    registry = catalog.series_registry()
    assert len(registry) == 24 and len({r["series_id"] for r in registry}) == 24
    assert sum(r["requires_release_alignment"] for r in registry) == 17
