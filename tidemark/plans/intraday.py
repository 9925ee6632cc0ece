"""Queries over ticks, sessions and the further documented measures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.catalog import SELECTED_TECHNICAL, SELECTED_TREASURY
from tidemark.functions.scalars import rounded
from tidemark.operators import curve, folds, intraday, models, research, stats
from tidemark.plans import panels, views
from tidemark.session import shared_folder
from tidemark.streaming import bars as streaming

BAR = ["symbol", "bar_start"]


def _as_ticks(events):
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"),
        F.col("event_id").alias("seq"),
    )


def _bars(spark, d):
    return intraday.bars_from_ticks(_as_ticks(views.table(spark, d, "events")))


def _session_bars(spark, d):
    def build(spark, d):
        return intraday.with_session(_bars(spark, d))

    return views._kept(spark, d, "session_bars", build)


def e01_five_minute_bars(spark, d):
    return rounded(_bars(spark, d))


def e01_streaming_bars(spark, d):
    """The same bars from a stream: every slot older than the watermark, each exactly once."""
    schema = views.table(spark, d, "events").schema
    ticks = _as_ticks(streaming.read_ticks(spark, d, schema, "events.parquet"))
    run = f"{shared_folder(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    streaming.run_to_table(streaming.streaming_bars(ticks), f"{run}/bars", f"{run}/state")
    return rounded(spark.read.parquet(f"{run}/bars"))


def e02_session_columns(spark, d):
    out = _session_bars(spark, d)
    flags = ["is_regular_session", "opening_30m", "power_hour"]
    return out.select(
        *BAR, "session_date", "minute_of_day", "minutes_from_open", "minutes_to_close", "day_of_week",
        *[F.col(f).cast("int").alias(f) for f in flags],
    )


def e03_bar_returns(spark, d):
    out = intraday.with_bar_returns(_session_bars(spark, d))
    columns = [f"ret_{m}m" for m in (5, 15, 30, 60, 120)] + [f"fwd_{m}m" for m in (15, 30, 60, 120)]
    return rounded(out.select(*BAR, *columns, *[F.col(f"dir_{m}m").cast("double").alias(f"dir_{m}m") for m in (15, 30, 60, 120)]))


def e04_session_vwap(spark, d):
    return rounded(intraday.with_vwap(_session_bars(spark, d)).select(*BAR, "vwap", "vwap_distance"))


def e05_session_volume(spark, d):
    out = intraday.with_session_volume(_session_bars(spark, d))
    return rounded(out.select(*BAR, "volume_15m", "volume_30m", "volume_60m", "relative_volume"))


def e06_realized_volatility(spark, d):
    out = intraday.with_realized_volatility(_session_bars(spark, d))
    return rounded(out.select(*BAR, "vol_15m", "vol_30m", "vol_60m", "range_pct"))


def e06_yield_changes(spark, d):
    """Two instruments of the ticks, read as yields on one grid of each session."""
    legs = {"ust10y": "view", "ust30y": "signup"}
    grid = intraday.session_grid(_session_bars(spark, d), legs, max_age=10)
    return rounded(intraday.with_yield_changes(grid, list(legs), {"curve_10s30s": ("ust10y", "ust30y")}))


def e07_macro_surprise(spark, d):
    """Published values against the event before as naive expectation."""
    events = panels.event_history(spark, d).select(
        "series_name",
        "event_release_date",
        F.col("payroll_level").alias("actual"),
        (F.col("payroll_level") - F.col("payroll_change_1m")).alias("consensus"),
    )
    out = intraday.with_surprise(events, ["series_name"], "event_release_date")
    return rounded(out.drop("actual", "consensus"), 4)


def e08_event_distance(spark, d):
    ticks = views.table(spark, d, "events").filter("value > 150")
    schedule = ticks.select(
        F.col("event_type").alias("symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("event_ts")
    ).distinct()
    return rounded(intraday.with_event_distance(_bars(spark, d).select(*BAR, "close"), schedule))


def e09_quality_flags(spark, d):
    flags = ["duplicate_timestamp", "invalid_price", "missing_interval", "stale_value", "outlier_flag"]
    out = intraday.quality_flags(views.bars_daily(spark, d), gap_days=3)
    return out.select("symbol", "market_date", *flags)


def e10_train_only_scaling(spark, d):
    names = [*SELECTED_TECHNICAL, *SELECTED_TREASURY]
    scalings = models.fold_scalings(panels.tagged(spark, d), names, "forward_return_5")
    rows = [
        (fold, f, s.median[f], s.mean[f], s.deviation[f]) for fold, s in scalings.items() for f in names if f in s.median
    ]
    return rounded(spark.createDataFrame(rows, "fold string, feature string, median double, mean double, deviation double"))


def e11_inversion_spells(spark, d):
    features = curve.curve_features(views.yield_curve(spark, d))
    return rounded(research.inversion_spells(features, "curve_slope_30y_3m_bp").drop("spell"))


def e11_spread_percentile(spark, d):
    features = curve.curve_features(views.yield_curve(spark, d)).select("curve_date", "curve_10y_2y_bp")
    spread = features.withColumn("curve_10y_2y_bp", F.round("curve_10y_2y_bp", 6))
    return rounded(research.trailing_percentile(spread, "curve_10y_2y_bp"))


def e11_growth_rates(spark, d):
    return rounded(research.growth_rates(panels.observations(spark, d)))


def e11_inflation_compensation(spark, d):
    """Large ticks as sparsely published yields: the last of a day, each leg with its own age limit."""
    day = F.to_date(F.col("ts").cast("timestamp"))
    ticks = views.table(spark, d, "events").select(F.col("event_type").alias("series_name"), day.alias("reference_date"), "ts", "event_id", "value")
    daily = ticks.filter("value > 200").groupBy("series_name", "reference_date").agg((F.max_by("value", F.struct("ts", "event_id")) / 100).alias("value"))
    legs = {"nominal_5y": ("view", 2), "real_5y": ("click", 1), "nominal_10y": ("signup", 2), "real_10y": ("purchase", 1)}
    return rounded(research.inflation_compensation(research.fresh_legs(ticks.select(F.col("reference_date").alias("market_date")), daily, legs)))


def e12_variance_inflation(spark, d):
    names = [*SELECTED_TECHNICAL, "yield_10y", "yield_30y", "curve_10y_2y_bp"]
    return rounded(research.variance_inflation(panels.features(spark, d), names))


def e12_variance_inflation_yields(spark, d):
    return rounded(research.variance_inflation(curve.complete_curves(views.yield_curve(spark, d)), ["yield_2y", "yield_10y", "yield_30y"]))


def e13_quintile_spread(spark, d):
    return rounded(research.quintile_spread(stats.quintile_summary(panels.rule_predictions(spark, d))))


def e13_strong_forecasts(spark, d):
    rows = panels.rule_predictions(spark, d).select(
        "model", (F.col("probability") - 0.5).alias("prediction"), F.col("forward_return_5").alias("actual")
    )
    return rounded(research.strong_forecast_hit_rate(rows))


def e14_forecast_outcomes(spark, d):
    bars = views.bars_daily(spark, d)
    log = folds.with_target_end(bars, 5).select(
        "symbol",
        F.col("market_date").alias("origin_date"),
        F.col("target_end_date").alias("target_date"),
        F.col("close").alias("origin_close"),
        F.lit(0.01).alias("forecast_return"),
    )
    return rounded(research.forecast_outcomes(log, bars))


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")
}
