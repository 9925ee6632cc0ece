"""Backward as-of joins: the latest right row at or before each left row.

Joins of market, macro and event tables fail closed: rows that break the contract of
the right side, or that would be seen before they were available, raise in the very
plan that joins them, without a pass of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel

HIT = "_hit"


def _latest_per_date(
    right: DataFrame, by: list[str], right_on: str, payload: list[str], tie: str | None, unique: str | None = None
) -> DataFrame:
    """One right row per (by, date): the one with the greatest ``tie``, then the greatest payload.

    With ``unique``, the name of the table, a second row of one (by, date) raises.
    """
    packed = F.struct(F.col(right_on), *[F.col(c) for c in payload if c != right_on])
    best = F.max_by(packed, F.struct(F.col(tie or right_on), packed))
    if unique is None:
        return right.groupBy(*by, right_on).agg(best.alias(HIT))
    grouped = right.groupBy(*by, right_on).agg(best.alias("_best"), F.count(F.lit(1)).alias("_copies"))
    hit = raised_where(F.col("_copies") > 1, F.col("_best"), f"{unique} has several rows of one {right_on}:", *by, right_on)
    return grouped.select(*by, right_on, hit.alias(HIT))


def raised_where(broken: Column, value: Column, message: str, *shown: str) -> Column:
    """``value``, but an error naming ``shown`` where ``broken`` holds."""
    text = F.concat_ws(" ", F.lit(message), *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in shown])
    return F.when(broken, F.raise_error(text)).otherwise(value)


def unique_keys(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df``, raising on a key that occurs twice; the count is a window over the key, in the same plan."""
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    counted = df.withColumn("_copies", copies)
    first = raised_where(F.col("_copies") > 1, F.col(keys[-1]), f"{what} has several rows of one key:", *keys)
    return counted.withColumn(keys[-1], first).drop("_copies")


def dates_asof(
    days: DataFrame,
    day: str,
    right: DataFrame,
    right_on: str,
    payload: Sequence[str],
    by: Sequence[str] = (),
    tie: str | None = None,
    unique: str | None = None,
) -> DataFrame:
    """For every date of ``days`` the latest right row, packed in ``_hit``.

    ``days`` holds distinct calendar dates, so the window below is bounded by
    the calendar for each right key, however large the tables behind are.
    """
    by = list(by)
    wanted = days.select(day).distinct()
    if by:
        wanted = wanted.crossJoin(F.broadcast(right.select(*by).distinct()))
    latest = _latest_per_date(right.filter(F.col(right_on).isNotNull()), by, right_on, list(payload), tie, unique)
    none = F.lit(None).cast(latest.schema[HIT].dataType)
    marks = wanted.select(*by, day, none.alias(HIT), F.lit(1).alias("_side")).unionByName(
        latest.select(*by, F.col(right_on).alias(day), HIT, F.lit(0).alias("_side"))
    )
    upto = Window.partitionBy(*by).orderBy(day, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.withColumn(HIT, F.last(HIT, ignorenulls=True).over(upto))
        .filter("_side = 1")
        .drop("_side")
    )


def join_by_calendar(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    payload: Sequence[str],
    tie: str | None = None,
    unique: str | None = None,
) -> DataFrame:
    """As-of join of a date-keyed table without a further key onto every left row.

    The as-of question is answered once per distinct date; left rows then meet
    calendar date. A row that sees a later date than its own raises; with ``unique``,
    the right table's name, so does a date of several right rows.
    """
    answers = dates_asof(left.select(left_on), left_on, right, right_on, payload, tie=tie, unique=unique)
    names = [c for c in payload if c != right_on]
    met = left.join(answers, left_on, "left").select(*left.columns, F.col(f"{HIT}.{right_on}").alias(right_on), *[F.col(f"{HIT}.{c}").alias(c) for c in names])
    early = raised_where(F.col(right_on) > F.col(left_on), F.col(right_on), "information from the future:", left_on, right_on)
    return met.withColumn(right_on, early)


def join_by_key(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    payload: Sequence[str],
    tie: str | None = None,
    unit: str = "day",
) -> DataFrame:
    """Keyed as-of join of two large tables.

    Rows meet inside (key, time bucket); the last right row of the buckets
    before is carried in from a table with one row per (key, bucket). A hot key
    is spread over its buckets. Left rows with a NULL key or time stay, unmatched.
    """
    by = list(by)
    names = [right_on, *[c for c in payload if c != right_on]]
    bucket = "_bucket"
    dated = right.filter(F.col(right_on).isNotNull()).dropna(subset=by)
    latest = _latest_per_date(dated, by, right_on, list(payload), tie)
    latest = latest.withColumn(bucket, F.date_trunc(unit, F.col(right_on)))
    none = F.lit(None).cast(latest.schema[HIT].dataType)
    row = F.struct(*[F.col(c) for c in left.columns])
    no_row = F.lit(None).cast(left.select(row.alias("_row_in")).schema["_row_in"].dataType)
    lefts = left.select(
        *by,
        F.date_trunc(unit, F.col(left_on)).alias(bucket),
        F.col(left_on).cast("timestamp").alias("_at"),
        row.alias("_left"),
        none.alias(HIT),
        F.lit(1).alias("_side"),
    )
    rights = latest.select(
        *by,
        bucket,
        F.col(right_on).cast("timestamp").alias("_at"),
        no_row.alias("_left"),
        HIT,
        F.lit(0).alias("_side"),
    )
    upto = Window.partitionBy(*by, bucket).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = (
        lefts.unionByName(rights)
        .withColumn(HIT, F.last(HIT, ignorenulls=True).over(upto))
        .filter("_side = 1")
    )
    ends = (
        latest.groupBy(*by, bucket)
        .agg(F.max_by(HIT, right_on).alias("_end"))
        .unionByName(lefts.select(*by, bucket).distinct().withColumn("_end", none))
        .groupBy(*by, bucket)
        .agg(F.first("_end", ignorenulls=True).alias("_end"))
    )
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, bucket, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = panel.join_null_safe(local, carried, [*by, bucket]).withColumn(HIT, F.coalesce(HIT, "_carried"))
    return found.select("_left.*", *[F.col(f"{HIT}.{c}").alias(c) for c in names])


def attach_curve(bars: DataFrame, features: DataFrame, day: str = "market_date", curve_day: str = "curve_date") -> DataFrame:
    """Latest curve row at or before each bar date, with its date and age in days.

    The curve has one row a date: a second one raises when the result is read.
    """
    payload = [c for c in features.columns if c not in bars.columns]
    joined = join_by_calendar(bars, features, day, curve_day, payload, unique="the curve")
    return joined.withColumnRenamed(curve_day, "treasury_observation_date").withColumn(
        "treasury_data_age_days", F.datediff(day, "treasury_observation_date")
    )


def macro_columns(series: str, prepared: DataFrame) -> DataFrame:
    """Merge-safe names for one prepared series; null observations carry no information.

    A value available before its own reference date raises when it is read; raw
    observations, which have no date of availability, are only renamed.
    """
    renames = {
        "value": series,
        "reference_date": f"{series}_reference_date",
        "release_date": f"{series}_release_date",
        "release_time": f"{series}_release_time",
        "release_timezone": f"{series}_release_timezone",
        "market_date_available": f"{series}_market_date_available",
    }
    known = prepared.filter(F.col("value").isNotNull())
    if {"market_date_available", "reference_date"} <= set(prepared.columns):
        known = _available_in_order(known)
    return known.select(*[F.col(c).alias(renames[c]) for c in renames if c in prepared.columns])


def _available_in_order(prepared: DataFrame) -> DataFrame:
    broken = F.col("market_date_available") < F.col("reference_date")
    available = raised_where(broken, F.col("market_date_available"), "available before its reference date:", "reference_date", "market_date_available")
    return prepared.withColumn("market_date_available", available)


def attach_macro_series(market: DataFrame, prepared: DataFrame, series: str, day: str = "market_date") -> DataFrame:
    """One macro series as known on each market date; same-day ties keep the newest reference.

    Two observations of one reference date raise when the result is read.
    """
    named = macro_columns(series, unique_keys(prepared.filter(F.col("value").isNotNull()), ["reference_date"], series))
    available = f"{series}_market_date_available"
    joined = join_by_calendar(market, named, day, available, named.columns, tie=f"{series}_reference_date")
    return joined.withColumn(f"{series}_data_age_days", F.datediff(day, available))


def attach_macro_family(
    market: DataFrame, prepared: DataFrame, series: Sequence[str], day: str = "market_date"
) -> DataFrame:
    """Many series at once: one as-of pass over (series, date), one pivot, one join.

    Two observations of one series and reference date raise when the result is read.
    """
    fields = [
        c
        for c in ("value", "reference_date", "release_date", "release_time", "release_timezone")
        if c in prepared.columns
    ]
    wanted = prepared.filter(F.col("value").isNotNull() & F.col("series_name").isin(list(series)))
    known = _available_in_order(unique_keys(wanted, ["series_name", "reference_date"], "a macro table"))
    answers = dates_asof(
        market.select(day), day, known, "market_date_available", fields, by=["series_name"], tie="reference_date"
    )
    wide = answers.groupBy(day).agg(
        *[
            F.max(F.when(F.col("series_name") == s, F.col(HIT))).alias(f"_{i}")
            for i, s in enumerate(series)
        ]
    )
    joined = market.join(wide, day, "left")
    out = [F.col(c) for c in market.columns]
    for i, s in enumerate(series):
        for f in fields:
            out.append(F.col(f"_{i}.{f}").alias(s if f == "value" else f"{s}_{f}"))
        available = F.col(f"_{i}.market_date_available")
        out.append(available.alias(f"{s}_market_date_available"))
        out.append(F.datediff(day, available).alias(f"{s}_data_age_days"))
    return joined.select(*out)


def attach_events(market: DataFrame, events: DataFrame, day: str = "market_date", release: str = "event_release_date") -> DataFrame:
    """Latest release event at or before each market date, days since it, release-day flag.

    A release date has one event: a second one raises when the result is read.
    """
    payload = [c for c in events.columns if c not in market.columns]
    joined = join_by_calendar(market, events, day, release, payload, unique="the release events")
    return joined.select(
        "*",
        F.datediff(day, release).alias("days_since_payroll_release"),
        F.coalesce(F.col(day) == F.col(release), F.lit(False)).cast("int").alias("payroll_release_day"),
    )
