"""Queries over bars, curve, folds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.catalog import (
    CURVE_FACTORS,
    CURVE_SERIES,
    LOGISTIC_MODELS,
    NS_FACTORS,
    RESEARCH_TECHNICAL_FEATURES,
    TREASURY_FEATURES,
    YIELDS,
)
from tidemark.functions.scalars import rounded
from tidemark.operators import asof, checks, curve, folds, models, panel, stats, technical
from tidemark.plans import panels, views
from tidemark.sources import readers

KEY = ["symbol", "market_date"]


def s01_bars_first_arrival(spark, d):
    raw = views.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("Date"),
        *[F.col("o_totalprice").alias(c) for c in ("Open", "High", "Low", "Close")],
        F.col("o_custkey").alias("Volume"),
        "o_orderkey",
    )
    bars = readers.normalize_bars(raw, ["o_orderkey"])
    return rounded(bars.select(*KEY, "open", "high", "low", "close", "volume"))


def s07_curve_pivot(spark, d):
    ids = F.array(*[F.lit(i) for i, _ in CURVE_SERIES.values()])
    long = views.curve_long(spark, d).select(
        F.col("curve_date").alias("date"), F.element_at(ids, F.col("slot") + 1).alias("series_id"), "value"
    )
    return rounded(curve.pivot_curve(long))


def s09_observation_normaliser(spark, d):
    raw = views.table(spark, d, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "P", F.lit(".")).otherwise(F.col("o_totalprice").cast("string")).alias("raw"),
    )
    return rounded(
        readers.normalize_observations(raw, "o_orderdate", "raw")
        .groupBy("reference_date")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.count("value").alias("readable"),
            F.sum("value").alias("total"),
        )
    )


def w00_bars_daily(spark, d):
    return rounded(views.bars_daily(spark, d))


def w01_trailing_returns(spark, d):
    out = technical.trailing_returns(views.bars_indexed(spark, d))
    return rounded(out.select(*KEY, *[f"return_{k}d" for k in (1, 3, 5, 10)]))


def w02_momentum(spark, d):
    bars = panel.spread(views.bars_indexed(spark, d), back=5)
    moved = F.col("close") - F.lag("close", 5).over(panel.window())
    return rounded(panel.settle(bars.withColumn("momentum", moved)).select(*KEY, "momentum"))


def w03_ema(spark, d):
    return rounded(technical.ema_features(views.bars_indexed(spark, d)).select(*KEY, "ema_9", "ema_21"), 3)


def w04_rsi(spark, d):
    return rounded(technical.ema_features(views.bars_indexed(spark, d)).select(*KEY, "rsi_14"))


def w05_ema_distances(spark, d):
    columns = ["ema_spread_pct", "close_vs_ema9", "close_vs_ema21", "rsi_centered"]
    return rounded(technical.ema_features(views.bars_indexed(spark, d)).select(*KEY, *columns))


def w06_volatility(spark, d):
    return rounded(technical.rolling_features(views.bars_indexed(spark, d)).select(*KEY, "volatility_5d", "volatility_20d"))


def w07_volume(spark, d):
    columns = ["volume_avg_20", "relative_volume", "log_volume"]
    return rounded(technical.rolling_features(views.bars_indexed(spark, d)).select(*KEY, *columns))


def w08_price_extremes(spark, d):
    columns = ["rolling_high_20", "rolling_low_20", "distance_from_20d_high", "distance_from_20d_low", "range_pct"]
    return rounded(technical.rolling_features(views.bars_indexed(spark, d)).select(*KEY, *columns))


def w10_forward_returns(spark, d):
    return rounded(technical.forward_returns(views.bars_indexed(spark, d)).select(*KEY, *panels.TARGETS))


SCORES = ["trend_score", "vwap_score", "rsi_score", "momentum_score", "volume_score", "directional_score"]


def w11_directional_score(spark, d):
    return technical.directional_score(views.bars_indexed(spark, d)).select(*KEY, *SCORES)


def w12_strength_label(spark, d):
    scored = technical.directional_score(views.bars_indexed(spark, d))
    return (
        scored.withColumn("strength", technical.strength_label())
        .groupBy("symbol", "strength")
        .agg(F.count(F.lit(1)).alias("bars"))
    )


def w13_edge_signals(spark, d):
    scored = technical.directional_score(views.bars_indexed(spark, d), keep_row=True)
    edges = technical.edge_signals(scored).filter("bullish_entry = 1 or bearish_exit = 1")
    return edges.select(*KEY, "bullish_entry", "bearish_exit")


def w14_signal_ledger(spark, d):
    return rounded(technical.signal_ledger(views.bars_indexed(spark, d)))


def technical_features_all(spark, d):
    columns = [*RESEARCH_TECHNICAL_FEATURES, "volume_avg_20", "rolling_high_20", "rolling_low_20"]
    return rounded(technical.technical_features(views.bars_indexed(spark, d)).select(*KEY, *columns))


def a01_score_summary(spark, d):
    out = stats.score_summary(panels.scored(spark, d))
    return rounded(out.withColumn("directional_score", F.col("directional_score").cast("int")))


def a06_pearson(spark, d):
    return rounded(stats.pearson_table(panels.features(spark, d), RESEARCH_TECHNICAL_FEATURES, panels.TARGETS))


def a08_technical_relationships(spark, d):
    return rounded(stats.relationships(panels.features(spark, d), RESEARCH_TECHNICAL_FEATURES, panels.TARGETS))


def a08_treasury_relationships(spark, d):
    return rounded(stats.relationships(panels.features(spark, d), TREASURY_FEATURES, panels.TARGETS))


def t03_top_features(spark, d):
    table = stats.relationships(panels.features(spark, d), TREASURY_FEATURES, ["forward_return_5"])
    best = table.select("feature", "observations", F.round("abs_spearman", 6).alias("abs_spearman"))
    return best.orderBy(F.desc_nulls_last("abs_spearman"), "feature").limit(10)


def w17_curve_changes(spark, d):
    out = curve.curve_features(views.yield_curve(spark, d))
    changes = [c for c in out.columns if c.startswith("change_")]
    slopes = [c for c in out.columns if c.startswith(("curve_10y", "curve_30y"))]
    return rounded(out.select("curve_date", *changes, *slopes))


def w18_curve_factors(spark, d):
    out = curve.curve_features(views.yield_curve(spark, d))
    wanted = [
        c
        for c in out.columns
        if c.startswith(("curve_level", "curve_slope", "curve_curvature")) or c.endswith("_volatility_20d")
    ]
    return rounded(out.select("curve_date", *wanted))


def m01_nelson_siegel(spark, d):
    fitted = curve.nelson_siegel_fit(views.yield_curve(spark, d))
    return rounded(fitted.select("curve_date", *NS_FACTORS, "ns_fit_rmse"))


def m01b_nelson_siegel_dynamics(spark, d):
    out = curve.nelson_siegel_features(views.yield_curve(spark, d))
    wanted = [c for c in out.columns if c.startswith("ns_beta") and c not in NS_FACTORS]
    return rounded(out.select("curve_date", *wanted))


def p02_complete_curves(spark, d):
    return rounded(curve.complete_curves(views.yield_curve(spark, d)).select("curve_date", *YIELDS))


def j01_curve_asof_bars(spark, d):
    bars = views.bars_daily(spark, d).select(*KEY, "close")
    features = curve.curve_features(views.yield_curve(spark, d)).select("curve_date", "yield_10y", *CURVE_FACTORS)
    joined = asof.attach_curve(bars, features)
    return rounded(joined.withColumn("treasury_data_age_days", F.col("treasury_data_age_days").cast("double")))


def j01_curve_asof_bars_keyed(spark, d):
    """The keyed strategy: every symbol gets its own copy of the curve dates it traded in."""
    bars = views.bars_daily(spark, d).select(*KEY, "close")
    level = views.yield_curve(spark, d).select("curve_date", "yield_10y")
    symbols = bars.select("symbol").distinct()
    right = level.crossJoin(F.broadcast(symbols))
    joined = asof.join_by_key(bars, right, ["symbol"], "market_date", "curve_date", ["yield_10y"], unit="month")
    return rounded(joined)


def v12_point_in_time_invariant(spark, d):
    joined = panels.regimes(spark, d)
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("treasury_observation_date") > F.col("market_date")).alias("future_rows"),
        F.count_if(F.col("treasury_observation_date").isNull()).alias("unmatched_rows"),
    )


def a18_data_age(spark, d):
    aged = panels.regimes(spark, d).withColumn("treasury_data_age_days", F.col("treasury_data_age_days").cast("double"))
    return stats.age_histogram(aged, "treasury_data_age_days")


def a18_null_counts(spark, d):
    return stats.null_counts(panels.features(spark, d), ["yield_2y", "yield_10y", "return_10d", "rsi_14", "volatility_20d"])


def m03_curve_regimes(spark, d):
    return panels.regimes(spark, d).groupBy("symbol", "treasury_regime").agg(F.count(F.lit(1)).alias("rows"))


def a02_regime_summary(spark, d):
    return rounded(stats.regime_summary(panels.development(spark, d)))


def a03_baseline(spark, d):
    return rounded(stats.unconditional_baseline(panels.development(spark, d)))


def a04_regime_excess(spark, d):
    rows = panels.development(spark, d)
    out = stats.with_excess(stats.regime_summary(rows), stats.unconditional_baseline(rows))
    excess = [c for c in out.columns if c.startswith("excess_")]
    return rounded(out.select("treasury_regime", "observations", *excess))


def w29_episodes(spark, d):
    out = curve.regime_episodes(panels.development(spark, d))
    return out.select(*KEY, "treasury_regime", "regime_episode_id", F.col("regime_episode_start").cast("int").alias("regime_episode_start"))


def a05_episode_summary(spark, d):
    return rounded(stats.episode_summary(curve.episode_starts(panels.development(spark, d))))


def m02_hac_inference(spark, d):
    return rounded(stats.hac_regime_effects(panels.development(spark, d)))


def w28_target_end(spark, d):
    return folds.with_target_end(views.bars_daily(spark, d), 5).select(*KEY, "target_end_date")


def f01_purged_range(spark, d):
    rows = folds.with_target_end(views.bars_daily(spark, d), 5)
    return folds.purged_range(rows, "1996-01-01", "1997-12-31").select(*KEY, "target_end_date")


def f03_walk_forward_folds(spark, d):
    return (
        panels.tagged(spark, d)
        .groupBy("fold", "role")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("market_date").alias("first_date"),
            F.max("market_date").alias("last_date"),
            F.max("target_end_date").alias("last_target"),
        )
    )


def p04_chronological_split(spark, d):
    rows = folds.chronological_split(views.bars_daily(spark, d), "2000-01-01")
    return rows.groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("rows"), F.max("market_date").alias("last_date"))


def p07_model_flags(spark, d):
    return panels.tagged(spark, d).select("fold", "role", *KEY, "bear_flattening", F.col("target_up_5d").cast("int").alias("target_up_5d"))


def a19_class_balance(spark, d):
    rows = panels.tagged(spark, d).filter("role = 'train'")
    return stats.class_balance(rows.withColumn("target_up_5d", F.col("target_up_5d").cast("int")), "target_up_5d")


def v20_holdout_lock(spark, d):
    rows = panels.tagged(spark, d)
    locked = checks.holdout_rows(rows, panels.LOCKED_YEAR, ["market_date", "target_end_date"])
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(locked.agg(F.count(F.lit(1)).alias("locked_rows")))


def w16_quintiles(spark, d):
    out = stats.with_quintile(panels.rule_predictions(spark, d))
    return rounded(out.select("model", "fold", *KEY, "probability", "probability_bucket"))


def a12_quintile_summary(spark, d):
    return rounded(stats.quintile_summary(panels.rule_predictions(spark, d)))


def a13_fold_quintiles(spark, d):
    return rounded(stats.quintile_summary(panels.rule_predictions(spark, d), ["fold", "model"]))


def a14_calibration(spark, d):
    return rounded(stats.calibration(panels.rule_predictions(spark, d)))


def a22_classification_metrics(spark, d):
    return rounded(stats.classification_metrics(panels.rule_predictions(spark, d)))


def a21_regression_metrics(spark, d):
    rows = panels.rule_predictions(spark, d).select(
        "fold", "model", F.col("forward_return_5").alias("actual"), (F.col("probability") - 0.5).alias("prediction")
    )
    return rounded(stats.regression_metrics(rows))


def a20_average_metrics(spark, d):
    metrics = stats.classification_metrics(panels.rule_predictions(spark, d))
    columns = ["roc_auc", "brier_score", "log_loss", "accuracy", "balanced_accuracy"]
    return rounded(stats.average_over_folds(metrics, columns, "roc_auc", descending=True))


def _train_facts(spark, d):
    """Train rows of every fold and how many of them rose: what each fit saw."""
    rows = panels.tagged(spark, d).filter("role = 'train' and forward_return_5 is not null")
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("train_rows"), F.avg("target_up_5d").alias("train_up_rate"))


def m04_ridge_walk_forward(spark, d):
    return rounded(stats.regression_metrics(panels.ridge_predictions(spark, d)).join(_train_facts(spark, d), "fold"))


def m04_single_ridge_walk_forward(spark, d):
    """Walk-forward ridge of one feature each, with the train rows each fit saw."""
    return rounded(stats.regression_metrics(panels.single_ridge_predictions(spark, d)).join(_train_facts(spark, d), "fold"))


def m05_logistic_predictions(spark, d):
    return rounded(panels.logistic_predictions(spark, d), 4)


def m06_baseline_forecasts(spark, d):
    rows = panels.tagged(spark, d).filter(F.col("forward_return_5").isNotNull())
    return rounded(
        rows.groupBy("fold").agg(
            F.avg(F.when(F.col("role") == "train", F.col("forward_return_5"))).alias("naive_mean"),
            F.avg(F.when(F.col("role") == "train", F.col("target_up_5d"))).alias("base_rate"),
            F.count_if(F.col("role") == "train").alias("train_rows"),
            F.count_if(F.col("role") == "validation").alias("validation_rows"),
        )
    )


def m07_logistic_walk_forward(spark, d):
    long = models.long_predictions(panels.logistic_predictions(spark, d), LOGISTIC_MODELS)
    return rounded(stats.classification_metrics(long).join(_train_facts(spark, d), "fold"), 4)


def m08_model_quintiles(spark, d):
    long = models.long_predictions(panels.logistic_predictions(spark, d), LOGISTIC_MODELS)
    return rounded(stats.quintile_summary(long), 4)


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")
}
