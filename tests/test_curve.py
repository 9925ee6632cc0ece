import numpy as np
import pandas as pd
import pytest
from helpers import TERMS, YIELDS, close_enough, curve_frame, day, days, pandas_sorted
from pyspark.sql import functions as F

from tidemark.operators import curve

DATES = days("2026-01-01", 30)


def linear_curve(spark):
    return curve_frame(spark, [[3 + 0.1 * j + 0.01 * i for j in range(10)] for i in range(30)], DATES)


def test_changes_slopes_and_volatility(spark):
    got = pandas_sorted(curve.curve_features(linear_curve(spark)), "curve_date")
    last = got.iloc[-1]
    assert last.change_10y_1d_bp == pytest.approx(1)
    assert last.change_2y_5d_bp == pytest.approx(5)
    assert last.change_30y_20d_bp == pytest.approx(20)
    assert last.curve_30y_2y_bp == pytest.approx(60)
    assert last.curve_level == pytest.approx(np.mean([3 + 0.1 * j + 0.29 for j in range(10)]))
    assert last.curve_slope_30y_3m_bp == pytest.approx(90)
    assert last.curve_curvature_5y_bp == pytest.approx((2 * 3.5 - 3 - 3.9) * 100)
    assert last.curve_level_change_5d_bp == pytest.approx(5)
    assert last.yield_10y_volatility_20d == pytest.approx(0, abs=1e-9)
    assert got.change_10y_5d_bp[:5].isna().all() and got.yield_10y_volatility_20d[:20].isna().all()


def test_lags_count_complete_curves_only(spark):
    rows = [[4.0 + 0.01 * i] * 10 for i in range(8)]
    rows[3] = [None, *rows[3][1:]]
    got = pandas_sorted(curve.curve_features(curve_frame(spark, rows, DATES[:8])), "curve_date")
    assert len(got) == 7
    assert got.change_10y_1d_bp[3] == pytest.approx(2)
    assert got.change_10y_5d_bp[5] == pytest.approx(6)


def test_nelson_siegel_recovers_known_factors(spark):
    loads = curve.nelson_siegel_loadings()
    rows = [(loads @ np.array([5 + 0.01 * i, -2, 1])).tolist() for i in range(30)]
    got = pandas_sorted(curve.nelson_siegel_features(curve_frame(spark, rows, DATES)), "curve_date")
    assert close_enough(got.ns_beta0_level, [5 + 0.01 * i for i in range(30)], 1e-10)
    assert close_enough(got.ns_beta1_slope, [-2] * 30, 1e-10)
    assert close_enough(got.ns_beta2_curvature, [1] * 30, 1e-10)
    assert got.ns_fit_rmse.max() < 1e-10
    last = got.iloc[-1]
    assert last.ns_beta0_level_change_5d_bp == pytest.approx(5)
    assert last.ns_beta1_slope_change_20d_bp == pytest.approx(0, abs=1e-8)


def test_nelson_siegel_equals_least_squares_on_noise(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(4, 1, (5, 10))
    got = pandas_sorted(curve.nelson_siegel_fit(curve_frame(spark, rows.tolist(), DATES[:5])), "curve_date")
    loads = curve.nelson_siegel_loadings()
    for i in range(5):
        beta, *_ = np.linalg.lstsq(loads, rows[i], rcond=None)
        assert got.loc[i, list(curve.NS_FACTORS)].astype(float).to_numpy() == pytest.approx(beta, abs=1e-9)
        assert got.ns_fit_rmse[i] == pytest.approx(np.sqrt(np.mean((rows[i] - loads @ beta) ** 2)))


@pytest.mark.parametrize("terms, decay", [([0.0, 1.0], 0.7), ([1.0, 2.0], 0.0), ([-1.0], 0.7)])
def test_nelson_siegel_arguments(terms, decay):
    with pytest.raises(ValueError):
        curve.nelson_siegel_loadings(terms, decay)


def test_nelson_siegel_needs_matching_grids(spark):
    with pytest.raises(ValueError):
        curve.nelson_siegel_fit(linear_curve(spark), YIELDS[:3], TERMS)


def test_pivot_names_the_published_series(spark):
    long = spark.createDataFrame([("2026-01-02", "DGS10", 4.2), ("2026-01-02", "DGS3MO", 4.4), ("2026-01-05", "DGS10", 4.3)], "date string, series_id string, value double")
    got = pandas_sorted(curve.pivot_curve(long), "timestamp")
    assert list(got.columns) == ["timestamp", *YIELDS]
    assert got.yield_10y.tolist() == [4.2, 4.3] and got.yield_3m[0] == 4.4 and pd.isna(got.yield_3m[1])


@pytest.mark.parametrize(
    "short, long, want",
    [
        (-5.0, -2.0, "bull_steepening"), (-2.0, -5.0, "bull_flattening"), (-3.0, -3.0, "bull_flattening"),
        (2.0, 5.0, "bear_steepening"), (5.0, 2.0, "bear_flattening"), (3.0, 3.0, "bear_flattening"),
        (-1.0, 1.0, "twist_steepening"), (1.0, -1.0, "twist_flattening"), (0.0, 1.0, "mixed_or_flat"),
        (None, 1.0, "unclassified"), (1.0, None, "unclassified"),
    ],
)
def test_regimes(spark, short, long, want):
    one = spark.createDataFrame([(short, long)], "change_2y_5d_bp double, change_30y_5d_bp double")
    row = curve.with_regime(one).withColumn("flag", curve.bear_flattening()).first()
    assert row.treasury_regime == want
    assert row.flag == (1 if (short, long) == (5.0, 2.0) else 0)


def test_episodes_per_symbol(spark):
    seq = ["a", "a", "b", "b", "b", "a"]
    rows = [(s, d, r) for s in ("X", "Y") for d, r in zip(DATES, seq, strict=False)]
    data = spark.createDataFrame(rows, "symbol string, market_date date, treasury_regime string")
    got = pandas_sorted(curve.regime_episodes(data), "symbol", "market_date")
    assert got.regime_episode_id.tolist() == [1, 1, 2, 2, 2, 3] * 2
    assert got.regime_episode_start.tolist() == [True, False, True, False, False, True] * 2
    assert curve.episode_starts(data).count() == 6


def test_observation_date(spark):
    one = spark.createDataFrame([("2026-01-02 23:30:00",)], "timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    assert curve.observation_date(one).first().treasury_observation_date == day("2026-01-02")
