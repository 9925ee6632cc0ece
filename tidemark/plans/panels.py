"""Joined panels the research queries share, each written once per application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.catalog import HORIZONS, LOGISTIC_MODELS, RIDGE_MODELS
from tidemark.functions.scalars import melt
from tidemark.operators import asof, curve, folds, models, payroll, technical, vintage
from tidemark.plans import views
from tidemark.plans.views import _kept

FOLDS = folds.yearly_folds("1995-01-01", (1998, 1999, 2000))
DEVELOPMENT_END = "2000-12-31"
LOCKED_YEAR = 2001
EVENT_SERIES = "1-URGENT"
MACRO_SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TARGETS = tuple(f"forward_return_{h}" for h in HORIZONS)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    """Technical features, forward returns with their target end, and curve features per bar."""
    bars = views.bars_indexed(spark, folder)
    technicals = technical.technical_features(bars)
    ahead = technical.forward_returns(bars).select("symbol", "market_date", *TARGETS)
    ends = folds.with_target_end(ahead, 5)
    curves = curve.all_curve_features(views.yield_curve(spark, folder))
    joined = asof.attach_curve(technicals.join(ends, ["symbol", "market_date"]), curves)
    return joined.withColumn(folds.YEAR, F.year("market_date"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "features", _features, folds.YEAR)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    bars = views.bars_indexed(spark, folder)
    return technical.forward_returns(technical.directional_score(bars, keep_row=True)).select(
        "symbol", "market_date", "directional_score", *TARGETS
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "scored", _scored)


def _regimes(spark: SparkSession, folder: str) -> DataFrame:
    """Forward returns and curve regime per bar: the columns regime research reads."""
    bars = views.bars_indexed(spark, folder)
    ahead = technical.forward_returns(bars).select("symbol", "market_date", *TARGETS)
    changes = curve.curve_features(views.yield_curve(spark, folder)).select(
        "curve_date", "change_2y_5d_bp", "change_30y_5d_bp"
    )
    return curve.with_regime(asof.attach_curve(ahead, changes))


def regimes(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "regimes", _regimes)


def development(spark: SparkSession, folder: str) -> DataFrame:
    return folds.development_rows(regimes(spark, folder), DEVELOPMENT_END)


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every (fold, role): date ranges of the feature panel."""
    return folds.assign_folds(models.with_targets(features(spark, folder)), FOLDS)


def rule_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Deterministic probabilities of three rules on the validation rows (long)."""
    rows = tagged(spark, folder).filter(
        (F.col("role") == "validation") & F.col("return_5d").isNotNull() & F.col("forward_return_5").isNotNull()
    )

    def clip(x):
        return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 3)

    first = clip(F.lit(0.5) + F.lit(0.1) * F.col("return_5d"))
    second = clip(F.lit(0.5) + F.lit(0.02) * F.coalesce(F.col("change_2y_5d_bp"), F.lit(0.0)))
    wide = rows.select(
        "symbol",
        "market_date",
        "fold",
        F.col("target_up_5d").cast("int").alias("actual_up"),
        "forward_return_5",
        first.alias("technical_probability"),
        second.alias("treasury_probability"),
        F.lit(0.5).alias("flat_probability"),
    )
    names = ["technical_probability", "treasury_probability", "flat_probability"]
    keep = ["symbol", "market_date", "fold", "actual_up", "forward_return_5"]
    return melt(wide, keep, names, "model", "probability")


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    return vintage.attach_release_calendar(
        views.vintages(spark, folder), views.release_calendar(spark, folder), enforce=True
    )


def _event_history(spark: SparkSession, folder: str) -> DataFrame:
    return payroll.event_history(
        views.vintages(spark, folder), views.event_calendar(spark, folder), enforce=True
    )


def event_history(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "event_history", _event_history)


def _event_market(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with forward return, target end and the latest release event of one series."""
    bars = views.bars_daily(spark, folder)
    market = folds.with_target_end(
        technical.forward_returns(bars, (5,)).select("symbol", "market_date", "close", "forward_return_5"), 5
    )
    events = event_history(spark, folder).filter(F.col("series_name") == EVENT_SERIES).drop("series_name")
    return asof.attach_events(market, events)


def event_market(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "event_market", _event_market)


def event_development(spark: SparkSession, folder: str) -> DataFrame:
    return folds.purged_development(event_market(spark, folder), DEVELOPMENT_END)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """First published value per (series, reference): the raw macro observations."""
    firsts = vintage.with_history(views.vintages(spark, folder)).filter("is_initial_release")
    # November periods count as unpublished, to exercise the null rule
    value = F.when(F.month("reference_date") != 11, F.col("value_as_known"))
    return firsts.select("series_name", "reference_date", value.alias("value"))


def partial_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """A calendar with holes: no rows for the reference months of July."""
    return views.release_calendar(spark, folder).filter(F.month("reference_date") != 7)


def _ridge(spark: SparkSession, folder: str) -> DataFrame:
    rows = tagged(spark, folder)
    scalings = models.fold_scalings(rows, models.all_features(RIDGE_MODELS), "forward_return_5")
    fits = models.fit_ridge(rows, RIDGE_MODELS, scalings)
    return models.ridge_predictions(rows, fits, scalings, RIDGE_MODELS)


def ridge_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "ridge_predictions", _ridge)


#: Ridge models of one feature each: their solution has a closed form.
SINGLE_RIDGE = {"oscillator_ridge": ("rsi_14",), "slope_ridge": ("curve_10y_2y_bp",)}


def single_ridge_predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = tagged(spark, folder)
    scalings = models.fold_scalings(rows, models.all_features(SINGLE_RIDGE), "forward_return_5")
    return models.ridge_predictions(rows, models.fit_ridge(rows, SINGLE_RIDGE, scalings), scalings, SINGLE_RIDGE)


def _logistic(spark: SparkSession, folder: str) -> DataFrame:
    rows = tagged(spark, folder)
    scalings = models.fold_scalings(rows, models.all_features(LOGISTIC_MODELS), "target_up_5d")
    fits = models.fit_logistic(rows, LOGISTIC_MODELS, scalings)
    return models.logistic_predictions(rows, fits, scalings, LOGISTIC_MODELS)


def logistic_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "logistic_predictions", _logistic)
