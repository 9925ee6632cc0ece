"""Bar features against pandas, leakage and block properties."""

import numpy as np
import pandas as pd
import pytest
from helpers import BAR_SCHEMA, bars, close_enough, days, pandas_sorted, walk
from pyspark.sql import functions as F

from tidemark.operators import panel, technical
from tidemark.operators.recurrence import Smooth, smooth


def expected(group: pd.DataFrame) -> pd.DataFrame:
    c, v = group.close, group.volume
    out = pd.DataFrame(index=group.index)
    for k in (1, 3, 5, 10):
        out[f"return_{k}d"] = c.pct_change(k)
    out["ema_9"] = c.ewm(span=9, adjust=False).mean()
    out["ema_21"] = c.ewm(span=21, adjust=False).mean()
    step = c.diff()
    gain = step.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    loss = (-step.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    out["rsi_14"] = 100 - 100 / (1 + gain / loss)
    out["volatility_5d"] = out.return_1d.rolling(5).std()
    out["volatility_20d"] = out.return_1d.rolling(20).std()
    out["relative_volume"] = v / v.rolling(20).mean()
    out["distance_from_20d_high"] = c / c.rolling(20).max() - 1
    out["distance_from_20d_low"] = c / c.rolling(20).min() - 1
    out["log_volume"] = np.log1p(v)
    for h in (1, 3, 5, 10, 20):
        out[f"forward_return_{h}"] = c.shift(-h) / c - 1
    return out


def test_features_equal_pandas_across_block_borders(spark):
    """2,300 rows span three blocks; the short symbol has one."""
    data = bars(spark, walk("AAA", 2300, 1), walk("BBB", 40, 2))
    ahead = technical.forward_returns(data).select(
        "symbol", "market_date", *[f"forward_return_{h}" for h in (1, 3, 5, 10, 20)]
    )
    got = pandas_sorted(
        technical.technical_features(data).join(ahead, ["symbol", "market_date"]), "symbol", "market_date"
    )
    want = pd.concat([expected(g) for _, g in got.groupby("symbol")])
    for column in want.columns:
        assert close_enough(got[column], want[column]), column


def test_rsi_starts_at_row_15_and_saturates(spark):
    up = pd.DataFrame(
        {"symbol": "UP", "market_date": days("2024-01-01", 20), "open": 1.0, "high": 1.0, "low": 1.0,
         "close": np.arange(1.0, 21.0), "volume": 1.0}
    )
    flat = up.assign(symbol="FLAT", close=5.0)
    got = pandas_sorted(technical.ema_features(bars(spark, up, flat)), "symbol", "market_date")
    rising = got[got.symbol == "UP"].rsi_14.reset_index(drop=True)
    assert rising[:14].isna().all() and (rising[14:] == 100).all()
    assert got[got.symbol == "FLAT"].rsi_14.isna().all()


def test_zero_close_gives_null_not_error(spark):
    zero = walk("Z", 30, 3)
    zero.loc[10, "close"] = 0.0
    got = pandas_sorted(technical.trailing_returns(bars(spark, zero)), "market_date")
    assert pd.isna(got.return_1d[11]) and got.return_1d[10] == -1


def test_truncation_invariance(spark):
    """Deleting the future leaves features unchanged."""
    full = walk("AAA", 1100, 4)
    a = pandas_sorted(technical.technical_features(bars(spark, full)), "market_date")[:1050]
    b = pandas_sorted(technical.technical_features(bars(spark, full[:1050])), "market_date")
    for c in a.columns[2:]:
        assert close_enough(a[c], b[c], 1e-12), c


def test_block_size_does_not_matter(spark):
    data = bars(spark, walk("AAA", 130, 5), walk("BBB", 61, 6))
    w = panel.window()

    def run(rows: int):
        frame = panel.spread(panel.index_rows(data, span="month"), back=5, ahead=3, rows=rows)
        frame = frame.select(
            "*",
            F.lag("close", 5).over(w).alias("back"),
            F.lead("close", 3).over(w).alias("ahead"),
            panel.rolling(F.avg, F.col("close"), 4, w).alias("mean4"),
        )
        out = panel.settle(smooth(frame, [Smooth("e", "close", 0.5)], rows=rows), rows=rows)
        return pandas_sorted(out, "symbol", "market_date")

    small, large = run(64), run(1024)
    for c in ("back", "ahead", "mean4", "e"):
        assert close_enough(small[c], large[c], 1e-12), c


def test_blocks_must_hold_their_borders():
    with pytest.raises(ValueError):
        panel.spread(None, back=2000)


def test_running_sum(spark):
    data = bars(spark, walk("AAA", 1500, 7), walk("BBB", 10, 8))
    got = panel.running_sum(panel.index_rows(data), {"total": F.col("volume")})
    got = pandas_sorted(got, "symbol", "market_date")
    assert close_enough(got.total, got.groupby("symbol").volume.cumsum(), 1e-12)


def test_score_range_and_vwap(spark):
    data = bars(spark, walk("AAA", 100, 9))
    plain = technical.directional_score(data).toPandas()
    assert plain.directional_score.between(-5, 5).all() and (plain.vwap_score == 0).all()
    with_vwap = technical.directional_score(data.withColumn("vwap", F.col("close") - 1)).toPandas()
    assert (with_vwap.vwap_score == 1).all()


def test_score_components_of_a_steady_rise(spark):
    rise = pd.DataFrame(
        {"symbol": "R", "market_date": days("2024-01-01", 40), "open": 1.0, "high": 1.0, "low": 1.0,
         "close": np.linspace(25, 35, 40), "volume": np.linspace(1e6, 2e6, 40)}
    )
    last = pandas_sorted(technical.directional_score(bars(spark, rise)), "market_date").iloc[-1]
    assert (last.trend_score, last.rsi_score, last.momentum_score, last.volume_score) == (1, 1, 1, 1)
    assert last.directional_score == 4


def test_signal_ledger_alternates_and_fills_at_next_open(spark):
    data = bars(spark, walk("AAA", 1400, 10), walk("BBB", 900, 11))
    ledger = pandas_sorted(technical.signal_ledger(data), "symbol", "entry_signal_date")
    opens = {(r.symbol, r.market_date): r.open for r in data.toPandas().itertuples()}
    assert len(ledger) > 2
    for row in ledger.itertuples():
        assert row.entry_date > row.entry_signal_date
        assert opens[row.symbol, row.entry_date] == row.entry_price
    for _, one in ledger.groupby("symbol"):
        closed = one.dropna(subset=["exit_date"])
        assert (closed.exit_date > closed.entry_date).all()
        assert (one.entry_signal_date[1:].values > one.exit_signal_date[:-1].values).all()
        assert close_enough(closed.total_pnl, ((closed.exit_price - closed.entry_price) * 100).cumsum(), 1e-9)


def test_edges_match_a_plain_loop(spark):
    data = bars(spark, walk("AAA", 1100, 12))
    scored = technical.directional_score(data, keep_row=True)
    got = pandas_sorted(technical.edge_signals(scored), "market_date")
    strong = got.directional_score >= 4
    want = strong & ~strong.shift(1, fill_value=False)
    assert (got.bullish_entry == want.astype(int)).all()


def test_empty_bars(spark):
    empty = spark.createDataFrame([], BAR_SCHEMA)
    assert technical.technical_features(empty).count() == 0
