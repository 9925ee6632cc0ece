"""Ticks to bars, sessions, event distance, flags, research measures, streaming forms."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import bars, day, days, pandas_sorted, walk
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import intraday, research
from tidemark.streaming import bars as streaming

T0 = datetime(2024, 1, 2, 14, 30)  # 09:30 in New York
TICKS = "symbol string, ts timestamp, price double, size long, seq long"


def ticks(spark, rows):
    return spark.createDataFrame([("A", T0 + timedelta(seconds=s), p, n, i) for i, (s, p, n) in enumerate(rows)], TICKS)


def test_bars_take_first_and_last_tick(spark):
    got = pandas_sorted(intraday.bars_from_ticks(ticks(spark, [(0, 10.0, 1), (10, 12.0, 2), (10, 9.0, 3), (300, 11.0, 4)])), "bar_start")
    first = got.iloc[0]
    assert (first.open, first.high, first.low, first.close, first.volume) == (10, 12, 9, 9, 6) and len(got) == 2


@pytest.fixture(scope="module")
def session(spark):
    rows = [(300 * i, 10.0 + i, i + 1) for i in range(8) if i != 3]  # the fourth bar is missing
    return intraday.with_session(intraday.bars_from_ticks(ticks(spark, rows))).persist()


def test_session_clock(session):
    first = pandas_sorted(session, "bar_start").iloc[0]
    assert (first.minute_of_day, first.minutes_from_open, first.minutes_to_close, first.day_of_week) == (570, 0, 390, 2)
    assert first.is_regular_session and first.opening_30m and not first.power_hour


def test_returns_do_not_bridge_gaps(session):
    got = pandas_sorted(intraday.with_bar_returns(session), "bar_start")
    assert got.ret_5m[1] == pytest.approx(math.log(11 / 10)) and pd.isna(got.ret_5m[3])
    assert pd.isna(got.fwd_15m[0]) and got.fwd_15m[1] == pytest.approx(14 / 11 - 1) and got.dir_15m[1] == 1


def test_vwap_and_volume(session):
    got = pandas_sorted(intraday.with_vwap(session), "bar_start")
    assert got.vwap[1] == pytest.approx((10 * 1 + 11 * 2) / 3)
    volume = pandas_sorted(intraday.with_session_volume(session), "bar_start")
    assert volume.volume_15m[2] == 1 + 2 + 3 and volume.volume_15m[3] == 3 + 5
    assert volume.relative_volume.isna().all()


def test_event_distance(spark, session):
    schedule = spark.createDataFrame([("A", T0 + timedelta(minutes=10))], "symbol string, event_ts timestamp")
    got = pandas_sorted(intraday.with_event_distance(session, schedule), "bar_start")
    assert got.minutes_until_event[0] == 10 and pd.isna(got.minutes_since_event[0])
    assert got.minutes_since_event[2] == 0 and got.minutes_until_event[2] == 0
    assert got.pre_event_15m[0] == 1 and got.post_event_15m[4] == 1 and pd.isna(got.minutes_until_event[4])


def test_quality_flags(spark):
    frame = walk("A", 30, 1)
    frame.loc[10:14, "close"] = 7.0
    frame.loc[20, "close"] = -1.0
    frame.loc[25:, "market_date"] = days("2021-03-01", 5)
    got = pandas_sorted(intraday.quality_flags(bars(spark, frame)), "market_date")
    assert got.stale_value.sum() == 2 and got.invalid_price[20] == 1 and got.missing_interval.sum() == 1
    twice = pd.concat([frame, frame[:1]])
    assert intraday.quality_flags(bars(spark, twice)).filter("duplicate_timestamp = 1").count() == 2
    doubled = pd.concat([frame, frame[5:8].assign(close=500.0)])
    flags = [
        sorted(map(tuple, intraday.quality_flags(bars(spark, part)).drop("open", "high", "low", "volume").collect()), key=str)
        for part in (doubled, doubled[::-1])
    ]
    assert flags[0] == flags[1]
    flagged = intraday.missing_indicators(bars(spark, frame).withColumn("x", F.lit(None).cast("double")), ["x"])
    assert flagged.filter("missing_x = 1").count() == 30


def test_surprise_uses_earlier_events_only(spark):
    rows = [("cpi", day(f"2024-{m:02d}-10"), float(a), 0.0) for m, a in enumerate([1, 3, 5, 2], 1)]
    data = spark.createDataFrame(rows, "event_name string, release_date date, actual double, consensus double")
    got = pandas_sorted(intraday.with_surprise(data, ["event_name"], "release_date", 2), "release_date")
    assert got.macro_surprise_z[:2].isna().all()
    assert got.macro_surprise_z[3] == pytest.approx(2 / np.std([1, 3, 5], ddof=1))


def test_variance_inflation(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    data = pd.DataFrame({"a": a, "b": b, "c": a + 0.5 * b + rng.normal(size=400)})
    data.loc[3, "a"] = np.nan  # an incomplete row
    got = {r["feature"]: r["vif"] for r in research.variance_inflation(spark.createDataFrame(data).replace(float("nan"), None), ["a", "b", "c"]).collect()}
    data = data.dropna()
    inverse = np.linalg.inv(np.corrcoef(data.to_numpy().T))
    assert [got[c] for c in data.columns] == pytest.approx(list(np.diag(inverse)))


def test_inversion_spells(spark):
    rows = list(zip(days("2024-01-01", 7), [1.0, -1.0, -3.0, 2.0, -1.0, 1.0, -2.0], strict=True))
    got = pandas_sorted(research.inversion_spells(spark.createDataFrame(rows, "curve_date date, s double"), "s"), "first_date")
    assert got.observations.tolist() == [2, 1, 1] and got.deepest.tolist() == [-3, -1, -2]


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    rows = [(60 * i, 10.0 + (i * 7) % 5, 1 + i % 3) for i in range(120)]
    data = ticks(spark, rows)
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.streaming_bars(streaming.read_ticks(spark, str(tmp_path / "in"), data.schema))
    streaming.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = pandas_sorted(spark.read.parquet(str(tmp_path / "out")), "bar_start")
    want = pandas_sorted(intraday.bars_from_ticks(data), "bar_start")
    horizon = T0 + timedelta(seconds=60 * 119) - timedelta(minutes=15)
    assert got.equals(want[want.bar_start <= horizon].reset_index(drop=True)) and len(got) > 15


def test_streaming_outcomes(spark, tmp_path):
    log = spark.createDataFrame([("A", T0 + timedelta(days=1), 10.0, 0.1), ("A", T0 + timedelta(days=9), 10.0, 0.1)], "symbol string, target_ts timestamp, origin_close double, forecast_return double")
    seen = spark.createDataFrame([("A", T0 + timedelta(days=1), 12.0), ("B", T0 + timedelta(days=9), 1.0)], "symbol string, ts timestamp, close double")
    log.write.parquet(str(tmp_path / "log"))
    seen.write.parquet(str(tmp_path / "seen"))
    joined = streaming.streaming_outcomes(
        spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")),
        spark.readStream.schema(seen.schema).parquet(str(tmp_path / "seen")),
    )
    streaming.run_to_table(joined, str(tmp_path / "out"), str(tmp_path / "state"))
    row = spark.read.schema(joined.schema).parquet(str(tmp_path / "out")).collect()
    assert len(row) == 1 and row[0].forecast_error == pytest.approx(0.1)


def test_log_return_to_a_zero_close_is_minus_infinity(spark):
    made = intraday.with_session(intraday.bars_from_ticks(ticks(spark, [(0, 10.0, 1), (300, 0.0, 1), (600, 5.0, 1)])))
    got = [(r.ret_5m, r.ret_15m) for r in intraday.with_bar_returns(made).orderBy("bar_start").collect()]
    assert got == [(None, None), (-math.inf, None), (None, None)]


def test_volatility_over_a_zero_close_is_infinite(spark):
    made = intraday.with_session(intraday.bars_from_ticks(ticks(spark, [(0, 10.0, 1), (300, 5.0, 1), (600, 0.0, 1), (900, 5.0, 1)])))
    got = [r.vol_15m for r in intraday.with_realized_volatility(made).orderBy("bar_start").collect()]
    assert got == [None, pytest.approx(math.log(2)), math.inf, math.inf]


def test_rounding_is_that_of_the_sql(spark):
    values = [16.4703125, -16.4703125, 33.0421875, 0.5e-6, -0.0, 1e300, math.inf, -math.inf, None]
    got = [r.x for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").coalesce(1)).orderBy("i").collect()]
    want = [duckdb.execute("select round(?::double, 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert got == want and got[0] == 16.470312
