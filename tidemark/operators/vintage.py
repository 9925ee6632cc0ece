"""Bitemporal series: what was known when.

A vintage event says that from ``vintage_date`` on the value of
``reference_date`` was known to be ``value_as_known``. Windows run over the
vintages of one reference period or the periods of one release, both bounded by
the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import nan_to_null, utc_date
from tidemark.operators import checks

VINTAGE_COLUMNS = ("series_name", "series_id", "reference_date", "vintage_date", "value_as_known")
PERIOD = ("series_name", "reference_date")


def normalize_vintages(data: DataFrame) -> DataFrame:
    """Dates as dates, values as doubles with anything unreadable as NULL."""
    checks.require_columns(data, VINTAGE_COLUMNS, "vintage events")
    return data.select(
        *[c for c in data.columns if c not in ("reference_date", "vintage_date", "value_as_known")],
        utc_date("reference_date").alias("reference_date"),
        utc_date("vintage_date").alias("vintage_date"),
        nan_to_null(F.expr("try_cast(value_as_known as double)")).alias("value_as_known"),
    )


def vintage_violations(data: DataFrame) -> DataFrame:
    """Row rules and duplicate events of a vintage table as one violations frame."""
    keys = ["series_name", "reference_date", "vintage_date"]
    rows = checks.row_violations(data, checks.vintage_rules(), keys)
    twice = checks.duplicate_keys(data, keys).select(F.lit("duplicate_event").alias("check"), *keys)
    return rows.unionByName(twice)


def prepare_vintages(data: DataFrame) -> DataFrame:
    """Normalised events, or an error when any rule is broken."""
    events = normalize_vintages(data)
    checks.enforce_not_empty(events, "vintage events")
    checks.enforce(vintage_violations(events), "invalid vintage events")
    return events


def series_vintages(data: DataFrame, series_name: str) -> DataFrame:
    events = normalize_vintages(data).filter(F.col("series_name") == series_name)
    return checks.enforce_not_empty(events, f"{series_name} vintages")


def with_history(events: DataFrame) -> DataFrame:
    """Per event: previous value, first vintage, end of validity, initial-release flag."""
    by_vintage = Window.partitionBy(*PERIOD).orderBy("vintage_date")
    period = Window.partitionBy(*PERIOD)
    return events.select(
        "*",
        F.lag("value_as_known", 1).over(by_vintage).alias("previous_value"),
        F.lead("vintage_date", 1).over(by_vintage).alias("known_until"),
        F.min("vintage_date").over(period).alias("first_vintage_date"),
    ).withColumn("is_initial_release", F.col("vintage_date") == F.col("first_vintage_date"))


def reconstruct_as_of(events: DataFrame, as_of: str) -> DataFrame:
    """The whole history as known on one date."""
    latest = F.struct("vintage_date", "value_as_known")
    return (
        events.filter(F.col("vintage_date") <= F.lit(as_of).cast("date"))
        .groupBy("series_name", "series_id", "reference_date")
        .agg(F.max_by(latest, "vintage_date").alias("_v"))
        .select(
            "series_name",
            "series_id",
            "reference_date",
            F.col("_v.vintage_date").alias("vintage_date"),
            F.col("_v.value_as_known").alias("value_as_known"),
            F.lit(as_of).cast("date").alias("as_of_date"),
        )
    )


def latest_period_as_of(events: DataFrame, as_of: str) -> DataFrame:
    """Newest reference period of every series as known on one date."""
    row = F.struct("series_id", "vintage_date", "value_as_known", "as_of_date")
    return (
        reconstruct_as_of(events, as_of)
        .groupBy("series_name")
        .agg(F.max("reference_date").alias("reference_date"), F.max_by(row, "reference_date").alias("_r"))
        .select("series_name", "reference_date", "_r.*")
    )


def states_as_of(events: DataFrame, dates: DataFrame, as_of: str = "as_of_date") -> DataFrame:
    """The history as known on each date of ``dates`` (columns series_name, as_of).

    Every event is valid over an interval of dates. Intervals and dates meet on
    (series, month), so a date only sees the events valid in its month and the
    work follows the size of the result: one row per (date, period).
    """
    wanted = dates.select("series_name", F.col(as_of).alias("as_of_date")).distinct()
    last = wanted.agg(F.max("as_of_date").alias("_last"))
    end = F.least(F.coalesce(F.date_sub("known_until", 1), F.col("_last")), F.col("_last"))
    months = F.sequence(F.trunc("vintage_date", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    intervals = (
        with_history(events)
        .drop("previous_value", "first_vintage_date", "is_initial_release")
        .crossJoin(F.broadcast(last))
        .filter(F.col("vintage_date") <= end)
        .withColumn("_month", F.explode(months))
        .drop("_last")
    )
    return (
        intervals.join(wanted.withColumn("_month", F.trunc("as_of_date", "month")), ["series_name", "_month"])
        .filter(
            (F.col("vintage_date") <= F.col("as_of_date"))
            & (F.col("known_until").isNull() | (F.col("as_of_date") < F.col("known_until")))
        )
        .drop("_month", "known_until")
    )


def with_period_change(states: DataFrame) -> DataFrame:
    """Level and one-period difference inside each reconstructed history."""
    periods = Window.partitionBy("series_name", "as_of_date").orderBy("reference_date")
    return states.select(
        "*",
        F.col("value_as_known").alias("payroll_level"),
        (F.col("value_as_known") - F.lag("value_as_known", 1).over(periods)).alias("payroll_change_1m"),
    )


def attach_release_calendar(events: DataFrame, calendar: DataFrame, enforce: bool = True) -> DataFrame:
    """Canonical events: release clock only where the vintage is the scheduled release.

    A value is available on its vintage date. With ``enforce`` an initial value
    without calendar row, or before its release, is an error.
    """
    checks.require_columns(calendar, ["series_name", "reference_date", "release_date", "release_time", "release_timezone"], "release calendar")
    if enforce:
        checks.enforce(checks.duplicate_keys(calendar, PERIOD), "duplicate release-calendar rows")
    joined = (
        with_history(events)
        .join(calendar.select(*PERIOD, "release_date", "release_time", "release_timezone"), list(PERIOD), "left")
        .withColumnRenamed("release_date", "original_release_date")
    )
    if enforce:
        checks.enforce(canonical_violations(joined), "initial vintages contradict the release calendar")
    on_time = F.col("vintage_date") == F.col("original_release_date")
    return joined.select(
        "series_name",
        "series_id",
        "reference_date",
        "original_release_date",
        F.when(on_time, F.col("release_time")).alias("release_time"),
        F.when(on_time, F.col("release_timezone")).alias("release_timezone"),
        "vintage_date",
        "value_as_known",
        F.col("vintage_date").alias("market_date_available"),
        "is_initial_release",
    )


def canonical_violations(joined: DataFrame) -> DataFrame:
    rules = {
        "initial_without_calendar": F.col("is_initial_release") & F.col("original_release_date").isNull(),
        "initial_before_release": F.col("is_initial_release")
        & (F.col("vintage_date") < F.col("original_release_date")),
    }
    return checks.row_violations(joined, rules, ["series_name", "reference_date", "vintage_date"])


def attach_event_timing(
    canonical: DataFrame, events: DataFrame, by: tuple[str, ...] = (), enforce: bool = True
) -> DataFrame:
    """Timing of the release event on the vintage date; revisions inherit it, others stay NULL."""
    checks.require_columns(events, ["event_name", "reference_date", "release_date", "release_time", "release_timezone"], "event calendar")
    if enforce:
        checks.enforce(checks.duplicate_keys(events, [*by, "release_date"]), "duplicate event release dates")
    named = events.select(
        *by,
        "event_name",
        F.col("reference_date").alias("event_reference_date"),
        F.col("release_date").alias("event_release_date"),
        F.col("release_time").alias("event_release_time"),
        F.col("release_timezone").alias("event_release_timezone"),
        F.col("release_date").alias("vintage_date"),
    )
    return canonical.join(named, [*by, "vintage_date"], "left").select(
        *canonical.columns,
        "event_name",
        "event_reference_date",
        "event_release_date",
        "event_release_time",
        "event_release_timezone",
    )


def vintage_profile(events: DataFrame) -> DataFrame:
    """Rows, reference periods, revised periods and vintage range per series."""
    return (
        events.groupBy(*PERIOD)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("vintage_date").alias("_first"),
            F.max("vintage_date").alias("_last"),
        )
        .groupBy("series_name")
        .agg(
            F.sum("_n").alias("vintage_rows"),
            F.count(F.lit(1)).alias("reference_periods"),
            F.count_if(F.col("_n") > 1).alias("revised_periods"),
            F.min("_first").alias("first_vintage"),
            F.max("_last").alias("last_vintage"),
        )
    )


def revision_rows(events: DataFrame) -> DataFrame:
    """Each revision as the difference to the vintage just before it."""
    return (
        with_history(events)
        .filter(F.col("vintage_date") > F.col("first_vintage_date"))
        .withColumn("revision", F.col("value_as_known") - F.col("previous_value"))
    )
