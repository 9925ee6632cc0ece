"""Intraday bars, session features, surprises, event distance and data-quality flags.

Windows run inside one (symbol, session) or one (symbol, time of day): at most
one row per five minutes of a day, or one per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change, log_ratio, ratio
from tidemark.operators import panel
from tidemark.operators.asof import join_by_key

ZONE = "America/New_York"
OPEN_MINUTE, CLOSE_MINUTE = 9 * 60 + 30, 16 * 60
BAR_MINUTES = 5


def bars_from_ticks(ticks: DataFrame, minutes: int = BAR_MINUTES) -> DataFrame:
    """OHLCV bars of (symbol, ts, price, size, seq) ticks; ``seq`` orders ticks of one instant.

    Works on a batch and, behind a watermark, on a stream: all aggregates are
    mergeable before the shuffle.
    """
    slot = F.window("ts", f"{minutes} minutes")
    at = F.struct("ts", "seq")
    return (
        ticks.groupBy("symbol", slot.alias("_slot"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").cast("double").alias("volume"),
        )
        .select("symbol", F.col("_slot.start").alias("bar_start"), "open", "high", "low", "close", "volume")
    )


def with_session(bars: DataFrame, ts: str = "bar_start", zone: str = ZONE) -> DataFrame:
    """Local session date, minute of day, distance to open and close, session parts."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour("_local") * 60 + F.minute("_local")
    return (
        bars.withColumn("_local", local)
        .select(
            *bars.columns,
            F.to_date("_local").alias("session_date"),
            minute.alias("minute_of_day"),
            (minute - OPEN_MINUTE).alias("minutes_from_open"),
            (CLOSE_MINUTE - minute).alias("minutes_to_close"),
            (F.dayofweek("_local") - 1).alias("day_of_week"),
        )
        .withColumn("is_regular_session", F.col("minute_of_day").between(OPEN_MINUTE, CLOSE_MINUTE - 1) & F.col("day_of_week").between(1, 5))
        .withColumn("opening_30m", F.col("minutes_from_open").between(0, 29))
        .withColumn("power_hour", F.col("minutes_to_close").between(1, 60))
    )


def _session(by: Sequence[str] = ("symbol", "session_date")):
    return Window.partitionBy(*by).orderBy("_second")


def _seconds(df: DataFrame, ts: str = "bar_start") -> DataFrame:
    return df.withColumn("_second", F.unix_timestamp(ts))


def _exactly(column: str, minutes: int) -> Column:
    """Value of the bar exactly ``minutes`` later (or earlier when negative) in the session."""
    shift = minutes * 60
    return F.first(column).over(_session().rangeBetween(shift, shift))


def with_bar_returns(
    bars: DataFrame, trailing: Sequence[int] = (5, 15, 30, 60, 120), forward: Sequence[int] = (15, 30, 60, 120)
) -> DataFrame:
    """Log returns over past minutes, simple returns and directions over coming minutes.

    A return is NULL when the other bar is not there; gaps are never bridged. The log
    return to a close of zero is minus infinity.
    """
    out = _seconds(bars)
    cells = [log_ratio("close", _exactly("close", -m)).alias(f"ret_{m}m") for m in trailing]
    cells += [change(_exactly("close", m), "close").alias(f"fwd_{m}m") for m in forward]
    return out.select(*bars.columns, *cells).select(
        "*",
        *[F.when(F.col(f"fwd_{m}m").isNotNull(), (F.col(f"fwd_{m}m") > 0).cast("int")).alias(f"dir_{m}m") for m in forward],
    )


def with_vwap(bars: DataFrame) -> DataFrame:
    """Session VWAP up to and including each bar, and the close's distance from it."""
    upto = _session().rowsBetween(Window.unboundedPreceding, 0)
    vwap = ratio(F.sum(F.col("close") * F.col("volume")).over(upto), F.sum("volume").over(upto))
    return _seconds(bars).withColumn("vwap", vwap).drop("_second").withColumn("vwap_distance", change("close", "vwap"))


def with_session_volume(bars: DataFrame, minutes: Sequence[int] = (15, 30, 60)) -> DataFrame:
    """Trailing volume sums and volume against earlier days at the same time of day."""
    days = Window.partitionBy("symbol", "minute_of_day").orderBy("session_date")
    past = days.rowsBetween(Window.unboundedPreceding, -1)
    sums = [
        F.sum("volume").over(_session().rangeBetween(-(m - BAR_MINUTES) * 60, 0)).alias(f"volume_{m}m") for m in minutes
    ]
    usual = ratio("volume", F.avg("volume").over(past)).alias("relative_volume")
    return _seconds(bars).select(*bars.columns, *sums, usual)


def with_realized_volatility(bars: DataFrame, minutes: Sequence[int] = (15, 30, 60)) -> DataFrame:
    """Root of summed squared bar returns over past minutes, and the bar's relative range.

    A fall to zero within those minutes makes the root infinite.
    """
    step = log_ratio("close", _exactly("close", -BAR_MINUTES))
    squared = _seconds(bars).withColumn("_sq", step * step)
    cells = [
        F.sqrt(F.sum("_sq").over(_session().rangeBetween(-(m - BAR_MINUTES) * 60, 0))).alias(f"vol_{m}m") for m in minutes
    ]
    return squared.select(*bars.columns, *cells, ratio(F.col("high") - F.col("low"), "close").alias("range_pct"))


def session_grid(
    bars: DataFrame, legs: dict[str, str], value: str = "close", max_age: int = 30, ts: str = "bar_start", minutes: int = BAR_MINUTES
) -> DataFrame:
    """Regular slots of each session with the last known ``value`` of every leg (name -> symbol).

    The slots run from the session's first to its last bar of any leg. A value is
    carried within its session for at most ``max_age`` minutes and is NULL beyond.
    One row per slot of a session, whatever the number of legs.
    """
    wide = (
        bars.filter(F.col("symbol").isin(*legs.values()))
        .groupBy("session_date", ts)
        .agg(*[F.max(F.when(F.col("symbol") == symbol, F.col(value))).alias(leg) for leg, symbol in legs.items()])
    )
    slots = wide.groupBy("session_date").agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    step = F.expr(f"interval {int(minutes)} minutes")
    grid = slots.select("session_date", F.explode(F.sequence("_from", "_to", step)).alias(ts))
    past = Window.partitionBy("session_date").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)

    def fresh(leg: str) -> Column:
        at = F.last(F.when(F.col(leg).isNotNull(), F.col(ts)), ignorenulls=True).over(past)
        age = F.unix_timestamp(ts) - F.unix_timestamp(at)
        return F.when(age <= max_age * 60, F.last(leg, ignorenulls=True).over(past)).alias(leg)

    return grid.join(wide, ["session_date", ts], "left").select("session_date", ts, *[fresh(leg) for leg in legs])


def with_yield_changes(
    grid: DataFrame, legs: Sequence[str], spreads: dict[str, tuple[str, str]], changes: Sequence[int] = (5, 15, 30, 60), ts: str = "bar_start", minutes: int = BAR_MINUTES
) -> DataFrame:
    """Changes of each leg and spread (name -> short, long leg) over past minutes, in basis points.

    ``grid`` is a `session_grid` of yields in percent: a change needs both of its slots fresh.
    """
    slots = Window.partitionBy("session_date").orderBy(ts)
    with_spreads = grid.select("*", *[((F.col(b) - F.col(a)) * 100).alias(f"{name}_bp") for name, (a, b) in spreads.items()])
    moved = [((F.col(leg) - F.lag(leg, m // minutes).over(slots)) * 100).alias(f"{leg}_chg_{m}m") for leg in legs for m in changes]
    moved += [(F.col(f"{s}_bp") - F.lag(f"{s}_bp", m // minutes).over(slots)).alias(f"{s}_chg_{m}m") for s in spreads for m in changes]
    return with_spreads.select("*", *moved)


def with_surprise(releases: DataFrame, by: Sequence[str], order: str, min_history: int = 12) -> DataFrame:
    """Actual minus expected, in deviations of earlier surprises of the same release."""
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    raw = F.col("macro_surprise_raw")
    z = F.when(F.count(raw).over(past) >= min_history, ratio(raw, F.stddev_samp(raw).over(past)))
    return (
        releases.withColumn("macro_surprise_raw", F.col("actual") - F.col("consensus"))
        .withColumn("macro_surprise_z", z)
        .withColumn("macro_positive_surprise", F.coalesce(raw > 0, F.lit(False)).cast("int"))
        .withColumn("macro_negative_surprise", F.coalesce(raw < 0, F.lit(False)).cast("int"))
    )


def with_event_distance(bars: DataFrame, schedule: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "bar_start") -> DataFrame:
    """Minutes since the last and until the next scheduled event, with window flags.

    Only event times are used, which are public beforehand. The next event is
    the last one at or before a row on the mirrored time axis.
    """
    by = list(by)
    seen = join_by_key(bars, schedule.select(*by, F.col("event_ts").alias("_last_event")), by, ts, "_last_event", [])
    mirrored = seen.withColumn("_mirror", F.timestamp_seconds(-F.unix_timestamp(ts)))
    ahead = schedule.select(*by, F.timestamp_seconds(-F.unix_timestamp("event_ts")).alias("_next_mirror"))
    both = join_by_key(mirrored, ahead, by, "_mirror", "_next_mirror", [])
    since = (F.unix_timestamp(ts) - F.unix_timestamp("_last_event")) / 60
    until = (-F.unix_timestamp("_next_mirror") - F.unix_timestamp(ts)) / 60
    timed = both.select(*bars.columns, since.alias("minutes_since_event"), until.alias("minutes_until_event"))
    after, before = F.col("minutes_since_event"), F.col("minutes_until_event")
    flags = [F.coalesce(after <= m, F.lit(False)).cast("int").alias(f"post_event_{m}m") for m in (15, 30, 60)]
    flags.append(F.coalesce(before <= 15, F.lit(False)).cast("int").alias("pre_event_15m"))
    return timed.select("*", *flags).withColumn(
        "is_event_window", F.greatest(F.col("post_event_60m"), F.col("pre_event_15m"))
    )


def quality_flags(
    bars: DataFrame,
    order: str = "market_date",
    gap_days: int = 7,
    stale_rows: int = 3,
    outlier: float = 10.0,
) -> DataFrame:
    """Flags for review; rows are never removed.

    duplicate: several rows share (symbol, time); invalid: price not positive;
    gap: more than ``gap_days`` since the row before; stale: close unchanged for
    ``stale_rows`` rows; outlier: absolute return above ``outlier``. Rows of one
    time go by close, all else the flags look at, so reruns agree.
    """
    copies = Window.partitionBy("symbol", order)
    counted = bars.withColumn("_copies", F.count(F.lit(1)).over(copies))
    w = panel.window()
    frame = panel.spread(panel.index_rows(counted, order=order, tie=["close"]), back=stale_rows)
    last = F.lag("close", 1).over(w)
    unchanged = F.when(
        F.count("close").over(w.rowsBetween(-stale_rows, 0)) == stale_rows + 1,
        F.max("close").over(w.rowsBetween(-stale_rows, 0)) == F.min("close").over(w.rowsBetween(-stale_rows, 0)),
    )
    out = frame.select(
        *bars.columns,
        panel.ROW,
        panel.BLOCK,
        (F.col("_copies") > 1).cast("int").alias("duplicate_timestamp"),
        (~F.coalesce(F.col("close") > 0, F.lit(False))).cast("int").alias("invalid_price"),
        F.coalesce(F.datediff(order, F.lag(order, 1).over(w)) > gap_days, F.lit(False)).cast("int").alias("missing_interval"),
        F.coalesce(unchanged, F.lit(False)).cast("int").alias("stale_value"),
        F.coalesce(F.abs(change("close", last)) > outlier, F.lit(False)).cast("int").alias("outlier_flag"),
    )
    return panel.settle(out)


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"missing_{c}") for c in columns])
