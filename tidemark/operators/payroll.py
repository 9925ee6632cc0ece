"""One row per release event of a revisable series, built for all events at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators import checks, vintage

BROAD_PERIODS = 2


def event_revisions(events: DataFrame) -> DataFrame:
    """Revisions of the two newest revised periods per (series, event)."""
    newest = Window.partitionBy("series_name", "vintage_date").orderBy(F.desc("reference_date"))
    ranked = vintage.revision_rows(events).withColumn("_rank", F.row_number().over(newest))

    def nth(n: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_rank") == n, F.col("revision"))), F.lit(0.0))

    return (
        ranked.filter("_rank <= 2")
        .groupBy("series_name", F.col("vintage_date").alias("event_date"))
        .agg(nth(1).alias("payroll_revision_1m"), nth(2).alias("payroll_revision_2m"))
        .withColumn("payroll_revision_total", F.col("payroll_revision_1m") + F.col("payroll_revision_2m"))
    )


def event_breadth(events: DataFrame) -> DataFrame:
    """How many reference periods an event published first or revised."""
    first = F.col("vintage_date") == F.col("first_vintage_date")
    return (
        vintage.with_history(events)
        .groupBy("series_name", F.col("vintage_date").alias("event_date"))
        .agg(
            F.count_if(first).cast("int").alias("payroll_initial_periods"),
            F.count_if(~first).cast("int").alias("payroll_revised_periods"),
        )
        .withColumn(
            "payroll_broad_revision_event", (F.col("payroll_revised_periods") > BROAD_PERIODS).cast("int")
        )
    )


def newest_periods(events: DataFrame) -> DataFrame:
    """After each first vintage: the newest and second-newest period known so far.

    The second newest is the running maximum of whatever was not the newest:
    ``min(period, newest before)``. One row per (series, first vintage date).
    """
    firsts = events.groupBy(*vintage.PERIOD).agg(F.min("vintage_date").alias("_first"))
    order = Window.partitionBy("series_name").orderBy("_first", "reference_date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        firsts.withColumn("newest_reference", F.max("reference_date").over(upto))
        .withColumn("_before", F.lag("newest_reference", 1).over(order))
        .withColumn("_beaten", F.when(F.col("_before").isNotNull(), F.least("reference_date", "_before")))
        .withColumn("second_reference", F.max("_beaten").over(upto))
        .groupBy("series_name", F.col("_first").alias("known_from"))
        .agg(F.max("newest_reference").alias("newest_reference"), F.max("second_reference").alias("second_reference"))
    )


def _value_on(dates: DataFrame, intervals: DataFrame, reference: str, out: str) -> DataFrame:
    """Value of period ``reference`` as known on ``event_date``: at most one interval matches."""
    known = intervals.select(
        "series_name",
        F.col("reference_date").alias(reference),
        F.col("vintage_date").alias("_from"),
        F.col("known_until").alias("_until"),
        F.col("value_as_known").alias(out),
    )
    met = dates.join(known, ["series_name", reference]).filter(
        (F.col("_from") <= F.col("event_date"))
        & (F.col("_until").isNull() | (F.col("event_date") < F.col("_until")))
    )
    return met.select("series_name", "event_date", out)


def latest_state(events: DataFrame, dates: DataFrame) -> DataFrame:
    """Newest period, its level and change to the period before, as known on each event date.

    ``dates`` has columns series_name, event_date.
    """
    wanted = dates.select("series_name", "event_date").distinct()
    steps = newest_periods(events).withColumn(
        "_until",
        F.lead("known_from", 1).over(Window.partitionBy("series_name").orderBy("known_from")),
    )
    marks = wanted.select(
        "series_name",
        "event_date",
        F.lit(None).cast("struct<newest_reference:date,second_reference:date>").alias("_state"),
        F.lit(1).alias("_side"),
    ).unionByName(
        steps.select(
            "series_name",
            F.col("known_from").alias("event_date"),
            F.struct("newest_reference", "second_reference").alias("_state"),
            F.lit(0).alias("_side"),
        )
    )
    upto = Window.partitionBy("series_name").orderBy("event_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        marks.withColumn("_state", F.last("_state", ignorenulls=True).over(upto))
        .filter("_side = 1")
        .select("series_name", "event_date", "_state.*")
    )
    intervals = vintage.with_history(events)
    level = _value_on(placed, intervals, "newest_reference", "payroll_level")
    before = _value_on(placed, intervals, "second_reference", "_level_before")
    key = ["series_name", "event_date"]
    return (
        placed.join(level, key, "left")
        .join(before, key, "left")
        .select(
            *key,
            F.col("newest_reference").alias("reference_date"),
            "payroll_level",
            (F.col("payroll_level") - F.col("_level_before")).alias("payroll_change_1m"),
        )
    )


def event_features(events: DataFrame, dates: DataFrame) -> DataFrame:
    """State, revisions and breadth of every requested event date."""
    key = ["series_name", "event_date"]
    quiet = {
        "payroll_revision_1m": 0.0,
        "payroll_revision_2m": 0.0,
        "payroll_revision_total": 0.0,
        "payroll_initial_periods": 0,
        "payroll_revised_periods": 0,
        "payroll_broad_revision_event": 0,
    }
    return (
        latest_state(events, dates)
        .join(event_revisions(events), key, "left")
        .join(event_breadth(events), key, "left")
        .fillna(quiet)
    )


def event_history(
    events: DataFrame, calendar: DataFrame, min_history: int = 12, enforce: bool = True
) -> DataFrame:
    """One feature row per calendar event, with prior-only z-scores.

    ``calendar``: series_name, event_name, reference_date, release_date,
    release_time, release_timezone. An event nothing was known for is an error.
    """
    named = calendar.select(
        "series_name",
        "event_name",
        F.col("reference_date").alias("event_reference_date"),
        F.col("release_date").alias("event_date"),
        F.col("release_time").alias("event_release_time"),
        F.col("release_timezone").alias("event_release_timezone"),
    )
    features = event_features(events, named)
    if enforce:
        checks.enforce(checks.duplicate_keys(named, ["series_name", "event_date"]), "duplicate event release dates")
        checks.enforce(
            features.filter(F.col("reference_date").isNull()).select("series_name", "event_date"),
            "events without any known history",
        )
    joined = named.join(features, ["series_name", "event_date"], "left").withColumnRenamed(
        "event_date", "event_release_date"
    )
    return with_zscores(joined, min_history)


def prior_z(value: str, history: Column, by: Sequence[str], order: str, min_history: int) -> Column:
    """Distance of a value from the mean of earlier events in their standard deviations."""
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    enough = F.count(history).over(past) >= min_history
    return F.when(
        enough,
        ratio(F.col(value) - F.avg(history).over(past), F.stddev_samp(history).over(past)),
    )


def with_zscores(
    features: DataFrame,
    min_history: int = 12,
    by: Sequence[str] = ("series_name",),
    order: str = "event_release_date",
) -> DataFrame:
    """Change and regular-revision z-scores; broad revisions neither get nor feed one."""
    checks.require_positive("min_history", min_history, 2)
    broad = F.col("payroll_broad_revision_event") == 1
    regular = F.when(F.col("payroll_broad_revision_event") == 0, F.col("payroll_revision_total"))
    return features.select(
        "*",
        prior_z("payroll_change_1m", F.col("payroll_change_1m"), by, order, min_history).alias("payroll_change_z"),
        F.when(~broad, prior_z("payroll_revision_total", regular, by, order, min_history)).alias("payroll_revision_z"),
    )


def largest_revisions(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` rows by absolute total revision, ties by date."""
    return (
        df.withColumn("abs_revision", F.abs("payroll_revision_total"))
        .orderBy(F.desc_nulls_last("abs_revision"), *columns)
        .select(*columns)
        .limit(top)
    )
