"""Bar features, directional score, signals and forward returns of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.catalog import HORIZONS
from tidemark.functions.scalars import change, flag, ratio, sign_score
from tidemark.operators import panel
from tidemark.operators.recurrence import Smooth, rsi, smooth, span_alpha
from tidemark.session import materialize

FAST_SPAN, SLOW_SPAN = 9, 21
RSI_LENGTH = 14
RSI_HIGH, RSI_LOW = 55, 45
VOLUME_ROWS = 20
STRONG_SCORE, MILD_SCORE = 4, 2


def _indexed(bars: DataFrame) -> DataFrame:
    return bars if panel.ROW in bars.columns else panel.index_rows(bars)


def _moves(frame: DataFrame) -> DataFrame:
    """One-row close difference split into gain and loss."""
    step = F.col("close") - F.lag("close", 1).over(panel.window())
    return frame.withColumn("_step", step).select(
        "*",
        F.greatest(F.col("_step"), F.lit(0.0)).alias("_gain"),
        F.greatest(-F.col("_step"), F.lit(0.0)).alias("_loss"),
    )


_CLOSE_MEANS = (
    Smooth("ema_9", "close", span_alpha(FAST_SPAN)),
    Smooth("ema_21", "close", span_alpha(SLOW_SPAN)),
)
_GAIN_LOSS = (
    Smooth("_avg_gain", "_gain", 1.0 / RSI_LENGTH, seed=1),
    Smooth("_avg_loss", "_loss", 1.0 / RSI_LENGTH, seed=1),
)


def _rsi_column():
    return F.when(F.col(panel.ROW) >= RSI_LENGTH, rsi("_avg_gain", "_avg_loss"))


def ema_features(bars: DataFrame) -> DataFrame:
    """EMA 9/21, RSI 14 and the distances built on them."""
    frame = _moves(panel.spread(_indexed(bars), back=1))
    done = panel.settle(
        smooth(frame, [*_CLOSE_MEANS, *_GAIN_LOSS]).withColumn("rsi_14", _rsi_column())
    ).drop("_step", "_gain", "_loss", "_avg_gain", "_avg_loss")
    return done.select(
        "*",
        change("ema_9", "ema_21").alias("ema_spread_pct"),
        change("close", "ema_9").alias("close_vs_ema9"),
        change("close", "ema_21").alias("close_vs_ema21"),
        ((F.col("rsi_14") - 50) / 50).alias("rsi_centered"),
    )


def technical_features(bars: DataFrame) -> DataFrame:
    """All continuous bar features; every window shares one block layout."""
    w = panel.window()
    frame = _moves(panel.spread(_indexed(bars), back=VOLUME_ROWS))
    returns = [change("close", F.lag("close", k).over(w)).alias(f"return_{k}d") for k in (1, 3, 5, 10)]
    frame = frame.select(
        "*",
        *returns,
        panel.rolling(F.avg, F.col("volume"), VOLUME_ROWS, w).alias("volume_avg_20"),
        panel.rolling(F.max, F.col("close"), VOLUME_ROWS, w).alias("rolling_high_20"),
        panel.rolling(F.min, F.col("close"), VOLUME_ROWS, w).alias("rolling_low_20"),
    )
    frame = frame.select(
        "*",
        *[panel.rolling(F.stddev_samp, F.col("return_1d"), k, w).alias(f"volatility_{k}d") for k in (5, 20)],
    )
    done = panel.settle(
        smooth(frame, [*_CLOSE_MEANS, *_GAIN_LOSS]).withColumn("rsi_14", _rsi_column()), keep_row=True
    ).drop("_step", "_gain", "_loss", "_avg_gain", "_avg_loss")
    return done.select(
        "*",
        change("ema_9", "ema_21").alias("ema_spread_pct"),
        change("close", "ema_9").alias("close_vs_ema9"),
        change("close", "ema_21").alias("close_vs_ema21"),
        ((F.col("rsi_14") - 50) / 50).alias("rsi_centered"),
        F.col("return_5d").alias("momentum_5d_pct"),
        F.col("return_10d").alias("momentum_10d_pct"),
        ratio(F.col("high") - F.col("low"), "close").alias("range_pct"),
        ratio("volume", "volume_avg_20").alias("relative_volume"),
        F.log1p("volume").alias("log_volume"),
        change("close", "rolling_high_20").alias("distance_from_20d_high"),
        change("close", "rolling_low_20").alias("distance_from_20d_low"),
    ).drop(panel.ROW)


def trailing_returns(bars: DataFrame, steps: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    w = panel.window()
    frame = panel.spread(_indexed(bars), back=max(steps))
    return panel.settle(
        frame.select("*", *[change("close", F.lag("close", k).over(w)).alias(f"return_{k}d") for k in steps])
    )


def rolling_features(bars: DataFrame) -> DataFrame:
    """Realised volatility, volume and price-range position over 5/20 rows."""
    w = panel.window()
    frame = panel.spread(_indexed(bars), back=VOLUME_ROWS)
    frame = frame.select(
        "*",
        change("close", F.lag("close", 1).over(w)).alias("return_1d"),
        panel.rolling(F.avg, F.col("volume"), VOLUME_ROWS, w).alias("volume_avg_20"),
        panel.rolling(F.max, F.col("close"), VOLUME_ROWS, w).alias("rolling_high_20"),
        panel.rolling(F.min, F.col("close"), VOLUME_ROWS, w).alias("rolling_low_20"),
    )
    frame = frame.select(
        "*",
        *[panel.rolling(F.stddev_samp, F.col("return_1d"), k, w).alias(f"volatility_{k}d") for k in (5, 20)],
    )
    return panel.settle(frame).select(
        "*",
        ratio(F.col("high") - F.col("low"), "close").alias("range_pct"),
        ratio("volume", "volume_avg_20").alias("relative_volume"),
        F.log1p("volume").alias("log_volume"),
        change("close", "rolling_high_20").alias("distance_from_20d_high"),
        change("close", "rolling_low_20").alias("distance_from_20d_low"),
    )


def forward_returns(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Target-only columns: return from this close to the close ``h`` rows ahead."""
    w = panel.window()
    frame = panel.spread(_indexed(bars), ahead=max(horizons))
    return panel.settle(
        frame.select(
            "*",
            *[change(F.lead("close", h).over(w), "close").alias(f"forward_return_{h}") for h in horizons],
        ),
        keep_row=panel.ROW in bars.columns,
    )


def directional_score(bars: DataFrame, keep_row: bool = False) -> DataFrame:
    """Five component scores in {−1, 0, 1} and their sum; unknown comparisons score 0."""
    w = panel.window()
    frame = _moves(panel.spread(_indexed(bars), back=VOLUME_ROWS))
    frame = frame.select(
        "*",
        (F.col("close") - F.lag("close", 5).over(w)).alias("momentum"),
        panel.rolling(F.avg, F.col("volume"), VOLUME_ROWS, w).alias("avg_volume"),
    )
    done = panel.settle(
        smooth(frame, [*_CLOSE_MEANS, *_GAIN_LOSS]).withColumn("rsi", _rsi_column()), keep_row=keep_row
    )
    busy = F.col("volume") > F.col("avg_volume")
    vwap = (
        sign_score(F.col("close") > F.col("vwap"), F.col("close") < F.col("vwap"))
        if "vwap" in bars.columns
        else F.lit(0)
    )
    scored = done.select(
        "*",
        sign_score(F.col("ema_9") > F.col("ema_21"), F.col("ema_9") < F.col("ema_21")).alias("trend_score"),
        vwap.alias("vwap_score"),
        sign_score(F.col("rsi") > RSI_HIGH, F.col("rsi") < RSI_LOW).alias("rsi_score"),
        sign_score(F.col("momentum") > 0, F.col("momentum") < 0).alias("momentum_score"),
        sign_score(busy & (F.col("_step") > 0), busy & (F.col("_step") < 0)).alias("volume_score"),
    ).drop("_step", "_gain", "_loss", "_avg_gain", "_avg_loss")
    parts = ["trend_score", "vwap_score", "rsi_score", "momentum_score", "volume_score"]
    return (
        scored.withColumn("directional_score", sum((F.col(p) for p in parts), F.lit(0)))
        .withColumn("high_volume", flag(busy))
        .withColumnRenamed("ema_9", "ema_fast")
        .withColumnRenamed("ema_21", "ema_slow")
    )


def strength_label(score: str = "directional_score"):
    s = F.col(score)
    return (
        F.when(s >= STRONG_SCORE, "strong_bullish")
        .when(s >= MILD_SCORE, "bullish")
        .when(s <= -STRONG_SCORE, "strong_bearish")
        .when(s <= -MILD_SCORE, "bearish")
        .otherwise("neutral")
    )


def _entering(condition, w):
    return (condition & ~F.coalesce(F.lag(condition, 1).over(w), F.lit(False))).cast("int")


def edge_signals(scored: DataFrame) -> DataFrame:
    """Flags on the row that enters a strong regime, and the open the order would fill at.

    Needs the row index column (``directional_score(..., keep_row=True)``).
    """
    w = panel.window()
    frame = panel.spread(scored, back=1, ahead=1)
    return panel.settle(
        frame.select(
            "*",
            _entering(F.col("directional_score") >= STRONG_SCORE, w).alias("bullish_entry"),
            _entering(F.col("directional_score") <= -STRONG_SCORE, w).alias("bearish_exit"),
            F.lead("open", 1).over(w).alias("fill_price"),
            F.lead("market_date", 1).over(w).alias("fill_date"),
        )
    )


def signal_ledger(bars: DataFrame, size: float = 100.0) -> DataFrame:
    """Round trips of the long-only rule: enter and exit at the next bar's open.

    Repeats of the side already held are dropped, so what is left alternates
    buy, sell, buy, ...
    """
    w = panel.window()
    priced = edge_signals(directional_score(bars, keep_row=True))
    edges = priced.filter((F.col("bullish_entry") == 1) | (F.col("bearish_exit") == 1)).select(
        "symbol",
        "market_date",
        F.when(F.col("bullish_entry") == 1, "buy").otherwise("sell").alias("side"),
        "fill_price",
        "fill_date",
    )
    # the few edges are written once: the steps below read them several times
    filled = panel.spread(panel.index_rows(materialize(edges.filter(F.col("fill_price").isNotNull()))), back=1)
    turns = panel.settle(filled.withColumn("_last", F.lag("side", 1).over(w))).filter(
        F.when(F.col("_last").isNull(), F.col("side") == "buy").otherwise(F.col("side") != F.col("_last"))
    )
    paired = panel.spread(panel.index_rows(turns.drop("_last")), ahead=1)
    trips = panel.settle(
        paired.select(
            "symbol",
            "side",
            F.col("market_date").alias("entry_signal_date"),
            F.col("fill_date").alias("entry_date"),
            F.col("fill_price").alias("entry_price"),
            F.lead("market_date", 1).over(w).alias("exit_signal_date"),
            F.lead("fill_date", 1).over(w).alias("exit_date"),
            F.lead("fill_price", 1).over(w).alias("exit_price"),
            panel.ROW,
            panel.BLOCK,
        ),
        keep_row=True,
    ).filter(F.col("side") == "buy")
    pnl = (F.col("exit_price") - F.col("entry_price")) * F.lit(size)
    return panel.running_sum(
        trips.drop("side").withColumn("amount", F.lit(size)).withColumn("trade_pnl", pnl),
        {"total_pnl": F.col("trade_pnl")},
    ).drop(panel.ROW)
