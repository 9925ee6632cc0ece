"""Yield-curve features, Nelson-Siegel factors, curve regimes and episodes.

A curve table has one row per observation date, so its windows are bounded by
the calendar (about 26,000 business days per century) and stay in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.catalog import (
    CURVE_SERIES,
    CURVE_STEPS,
    MATURITIES,
    NELSON_SIEGEL_DECAY,
    NS_FACTORS,
    TERMS,
    YIELDS,
)
from tidemark.functions.scalars import flag, utc_date
from tidemark.operators import panel

SLOPE_LEGS = (("10y", "2y"), ("30y", "2y"), ("30y", "5y"), ("30y", "10y"))


def pivot_curve(observations: DataFrame, date: str = "date", series: str = "series_id", value: str = "value") -> DataFrame:
    """Long observations by published series id to one wide row per date."""
    ids = [series_id for series_id, _ in CURVE_SERIES.values()]
    wide = observations.groupBy(date).pivot(series, ids).agg(F.first(value, ignorenulls=True))
    return wide.select(
        F.col(date).alias("timestamp"),
        *[F.col(i).cast("double").alias(y) for i, y in zip(ids, YIELDS, strict=True)],
    )


def complete_curves(curve: DataFrame) -> DataFrame:
    """Only dates with all ten maturities: later lags count valid observations."""
    return curve.dropna(subset=list(YIELDS))


def _over(order: str, by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(order)


def _step(column: str, k: int, w, scale: float = 1.0) -> Column:
    moved = F.col(column) - F.lag(column, k).over(w)
    return moved * F.lit(scale) if scale != 1.0 else moved


def curve_features(curve: DataFrame, order: str = "curve_date", by: Sequence[str] = ()) -> DataFrame:
    """Changes, slopes, level/slope/curvature factors and their 20-observation volatility."""
    w = _over(order, by)
    base = complete_curves(curve).select(
        "*",
        *[
            ((F.col(f"yield_{a}") - F.col(f"yield_{b}")) * 100).alias(f"curve_{a}_{b}_bp")
            for a, b in SLOPE_LEGS
        ],
        (sum((F.col(y) for y in YIELDS[1:]), F.col(YIELDS[0])) / len(YIELDS)).alias("curve_level"),
        ((F.col("yield_30y") - F.col("yield_3m")) * 100).alias("curve_slope_30y_3m_bp"),
        ((2 * F.col("yield_5y") - F.col("yield_3m") - F.col("yield_30y")) * 100).alias(
            "curve_curvature_5y_bp"
        ),
    )
    moved = base.select(
        "*",
        *[
            _step(f"yield_{m}", k, w, 100.0).alias(f"change_{m}_{k}d_bp")
            for m in MATURITIES
            for k in CURVE_STEPS
        ],
        *[
            _step(f"curve_{a}_{b}_bp", k, w).alias(f"curve_{a}_{b}_bp_change_{k}d")
            for a, b in SLOPE_LEGS
            for k in CURVE_STEPS
        ],
        *[_step("curve_level", k, w, 100.0).alias(f"curve_level_change_{k}d_bp") for k in CURVE_STEPS],
        *[_step("curve_slope_30y_3m_bp", k, w).alias(f"curve_slope_change_{k}d_bp") for k in CURVE_STEPS],
        *[
            _step("curve_curvature_5y_bp", k, w).alias(f"curve_curvature_change_{k}d_bp")
            for k in CURVE_STEPS
        ],
    )
    volatile = {
        "yield_10y_volatility_20d": "change_10y_1d_bp",
        "yield_30y_volatility_20d": "change_30y_1d_bp",
        "curve_level_volatility_20d": "curve_level_change_1d_bp",
        "curve_slope_volatility_20d": "curve_slope_change_1d_bp",
        "curve_curvature_volatility_20d": "curve_curvature_change_1d_bp",
    }
    return moved.select(
        "*",
        *[panel.rolling(F.stddev_samp, F.col(c), 20, w).alias(out) for out, c in volatile.items()],
    )


def nelson_siegel_loadings(terms: Sequence[float] = TERMS, decay: float = NELSON_SIEGEL_DECAY) -> np.ndarray:
    terms = np.asarray(terms, dtype=float)
    if (terms <= 0).any():
        raise ValueError("maturities must be positive")
    if decay <= 0:
        raise ValueError("decay must be positive")
    z = decay * terms
    slope = -np.expm1(-z) / z
    return np.column_stack([np.ones_like(z), slope, slope - np.exp(-z)])


def nelson_siegel_fit(
    curve: DataFrame,
    yields: Sequence[str] = YIELDS,
    terms: Sequence[float] = TERMS,
    decay: float = NELSON_SIEGEL_DECAY,
) -> DataFrame:
    """Least-squares factors per row.

    The maturity grid and the decay are constants, so the fit is a fixed linear
    map of the yields and runs as plain column arithmetic.
    """
    if len(yields) != len(terms):
        raise ValueError("yields and maturities must have the same length")
    loadings = nelson_siegel_loadings(terms, decay)
    solve = np.linalg.pinv(loadings)

    def combine(weights: np.ndarray, columns: Sequence[str]) -> Column:
        terms_ = [F.lit(float(v)) * F.col(c) for v, c in zip(weights, columns, strict=True)]
        return sum(terms_[1:], terms_[0])

    fitted = curve.dropna(subset=list(yields)).select(
        "*", *[combine(solve[i], yields).alias(f) for i, f in enumerate(NS_FACTORS)]
    )
    squares = [
        (F.col(y) - combine(loadings[j], NS_FACTORS)) * (F.col(y) - combine(loadings[j], NS_FACTORS))
        for j, y in enumerate(yields)
    ]
    return fitted.withColumn("ns_fit_rmse", F.sqrt(sum(squares[1:], squares[0]) / len(yields)))


def nelson_siegel_features(curve: DataFrame, order: str = "curve_date", by: Sequence[str] = ()) -> DataFrame:
    w = _over(order, by)
    moved = nelson_siegel_fit(curve).select(
        "*",
        *[
            _step(f, k, w, 100.0).alias(f"{f}_change_{k}d_bp")
            for f in NS_FACTORS
            for k in CURVE_STEPS
        ],
    )
    return moved.select(
        "*",
        *[
            panel.rolling(F.stddev_samp, F.col(f"{f}_change_1d_bp"), 20, w).alias(f"{f}_volatility_20d")
            for f in NS_FACTORS
        ],
    )


def all_curve_features(curve: DataFrame, order: str = "curve_date", by: Sequence[str] = ()) -> DataFrame:
    """Empirical and fitted features side by side: two projections of one scan, no join."""
    return nelson_siegel_features(curve_features(curve, order, by), order, by)


def observation_date(curve: DataFrame) -> DataFrame:
    return curve.withColumn("treasury_observation_date", utc_date("timestamp"))


def curve_regime(short: str = "change_2y_5d_bp", long: str = "change_30y_5d_bp") -> Column:
    """Regime of a pair of 5-observation changes; equal moves count as flattening."""
    s, l = F.col(short), F.col(long)
    return (
        F.when(s.isNull() | l.isNull(), "unclassified")
        .when((s < 0) & (l < 0), F.when(s < l, "bull_steepening").otherwise("bull_flattening"))
        .when((s > 0) & (l > 0), F.when(l > s, "bear_steepening").otherwise("bear_flattening"))
        .when((s < 0) & (l > 0), "twist_steepening")
        .when((s > 0) & (l < 0), "twist_flattening")
        .otherwise("mixed_or_flat")
    )


def bear_flattening(short: str = "change_2y_5d_bp", long: str = "change_30y_5d_bp") -> Column:
    s, l = F.col(short), F.col(long)
    return flag((s > 0) & (l > 0) & (s > l))


def with_regime(df: DataFrame) -> DataFrame:
    return df.withColumn("treasury_regime", curve_regime())


def regime_episodes(
    df: DataFrame, by: Sequence[str] = ("symbol",), order: str = "market_date"
) -> DataFrame:
    """Episode number per key and whether a row opens its episode."""
    frame = panel.spread(panel.index_rows(df, by, order), back=1)
    before = F.lag("treasury_regime", 1).over(panel.window(by))
    opens = before.isNull() | (F.col("treasury_regime") != before)
    marked = panel.settle(frame.withColumn("regime_episode_start", opens), keep_row=True)
    return panel.running_sum(
        marked, {"regime_episode_id": F.col("regime_episode_start").cast("long")}, by
    ).drop(panel.ROW)


def episode_starts(df: DataFrame, by: Sequence[str] = ("symbol",), order: str = "market_date") -> DataFrame:
    return regime_episodes(df, by, order).filter("regime_episode_start")
