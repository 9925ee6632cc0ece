"""Release calendars: expansion of event calendars, exceptions, release attachment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.catalog import (
    EMPLOYMENT_SERIES,
    ESTABLISHMENT_SERIES,
    LATE_RELEASE,
    requires_release_alignment,
    series_registry,
)
from tidemark.operators import checks

CALENDAR_COLUMNS = ("series_name", "reference_date", "release_date", "release_time", "release_timezone")


def registry(spark) -> DataFrame:
    """The series registry as a small dimension table."""
    return spark.createDataFrame(
        series_registry(),
        "series_name string, series_id string, name string, category string, source string, frequency string, "
        "units string, transformation string, requires_release_alignment boolean, requires_vintage_tracking boolean",
    )


def normalize_calendar(calendar: DataFrame) -> DataFrame:
    return (
        calendar.withColumn("reference_date", F.to_date("reference_date"))
        .withColumn("release_date", F.to_date("release_date"))
        .withColumn("release_time", F.coalesce(checks.normalized_time("release_time"), F.col("release_time")))
    )


def calendar_violations(
    calendar: DataFrame, name_column: str, expected: str | None = None, keys: Sequence[str] = ("reference_date",)
) -> DataFrame:
    """All broken rules of a calendar: row rules, unknown zones, duplicate keys."""
    shown = [name_column, "reference_date", "release_date"]
    rows = checks.row_violations(calendar, checks.calendar_rules(name_column, expected), shown)
    zones = checks.unknown_timezones(
        calendar.filter(F.col("release_timezone").isNotNull()), "release_timezone"
    ).select(F.lit("invalid_timezone").alias("check"), *shown)
    twice = checks.duplicate_keys(calendar, [name_column, *keys]).select(F.lit("duplicate_row").alias("check"), name_column, *keys)
    return rows.unionByName(zones).unionByName(twice, allowMissingColumns=True)


def prepare_calendar(calendar: DataFrame, name_column: str, expected: str | None = None) -> DataFrame:
    normal = normalize_calendar(calendar)
    checks.enforce(calendar_violations(normal, name_column, expected), "invalid release calendar")
    return normal


def series_calendar(calendars: DataFrame, series_name: str) -> DataFrame:
    """Calendar rows of one series; refuses series that need none, fails when absent."""
    if not requires_release_alignment(series_name):
        raise checks.DataCheckError(f"{series_name} does not require release alignment")
    rows = calendars.filter(F.col("series_name") == series_name)
    checks.enforce_not_empty(rows, f"release calendar of {series_name}")
    return prepare_calendar(rows, "series_name", series_name)


def expand_event_calendar(events: DataFrame, series: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One calendar row per (event, series published with it); a narrow step. ``by`` tells event calendars apart."""
    names = F.array(*[F.lit(s) for s in series])
    return events.select(
        *by,
        F.explode(names).alias("series_name"),
        "reference_date",
        "release_date",
        "release_time",
        "release_timezone",
    )


def add_late_release(calendars: DataFrame, series: Sequence[str] = ESTABLISHMENT_SERIES, by: Sequence[str] = ()) -> DataFrame:
    """Append the documented late release to the series it concerns, in each calendar of ``by``."""
    reference, release, time, zone = LATE_RELEASE
    rows = calendars.sparkSession.createDataFrame(
        [(s, reference, release, time, zone) for s in series],
        ", ".join(f"{c} string" for c in CALENDAR_COLUMNS),
    ).select(
        "series_name",
        F.to_date("reference_date").alias("reference_date"),
        F.to_date("release_date").alias("release_date"),
        "release_time",
        "release_timezone",
    )
    columns = [*by, *CALENDAR_COLUMNS]
    extra = rows.join(calendars.select(*by, "series_name").distinct(), "series_name").select(columns)
    return calendars.select(columns).unionByName(extra)


def employment_calendars(events: DataFrame) -> DataFrame:
    """Calendars of all employment-report series, validated, with the late release."""
    prepared = prepare_calendar(events, "event_name", "employment_situation")
    full = add_late_release(expand_event_calendar(prepared, EMPLOYMENT_SERIES))
    checks.enforce(checks.duplicate_keys(full, ["series_name", "reference_date"]), "duplicate calendar rows")
    return full


def attach_releases(observations: DataFrame, calendar: DataFrame, enforce: bool = False) -> DataFrame:
    """Left many-to-one join on (series, reference period).

    With ``enforce`` the calendar must be unique and every non-null observation
    must find its release.
    """
    key = ["series_name", "reference_date"]
    joined = observations.join(
        calendar.select(*key, "release_date", "release_time", "release_timezone"), key, "left"
    )
    if enforce:
        checks.enforce(checks.duplicate_keys(calendar, key), "duplicate calendar rows")
        missing = checks.coverage_problems(joined).select(*key).orderBy("reference_date")
        checks.enforce(missing, "observations without release metadata")
    return joined


def release_sensitive(observations: DataFrame, calendar: DataFrame, enforce: bool = False) -> DataFrame:
    """Available on the release date."""
    joined = attach_releases(observations, calendar, enforce)
    return joined.withColumn("market_date_available", F.col("release_date"))


def market_observed(observations: DataFrame) -> DataFrame:
    """Series observed in the market are available on their own date."""
    return observations.withColumn("market_date_available", F.col("reference_date"))


def release_instant(time: str = "release_time", zone: str = "release_timezone", day: str = "release_date"):
    """UTC instant of a local release clock."""
    local = F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.col(time)), "yyyy-MM-dd HH:mm")
    return F.to_utc_timestamp(local, F.col(zone))
