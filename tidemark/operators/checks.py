"""Fail-closed data checks.

A check is a frame of violations; ``enforce`` raises when it is not empty.
Row rules of one table are evaluated together in a single pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio


class DataCheckError(ValueError):
    """A table broke a rule it must satisfy before use."""


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise DataCheckError(f"{what} is missing required columns: {missing}")
    return df


def require_positive(name: str, value: float, least: float = 1) -> None:
    if value < least:
        raise DataCheckError(f"{name} must be at least {least}")


def require_order(name: str, first, second, strict: bool = False) -> None:
    if first > second or (strict and first == second):
        raise DataCheckError(f"{name}: {first} must come before {second}")


def row_violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Long table (check, keys...) of rows breaking a rule; NULL conditions do not fire."""
    fired = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(fired).alias("check"), *keys)


def rule_counts(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows and broken rows per rule in one aggregate."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked_rows"), *[F.count_if(c).alias(n) for n, c in rules.items()]
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def missing_values(columns: Sequence[str]) -> dict[str, Column]:
    return {f"missing_{c}": F.col(c).isNull() for c in columns}


def before(later: str, earlier: str) -> Column:
    """True where ``later`` wrongly precedes ``earlier``."""
    return F.col(later) < F.col(earlier)


def unexpected_name(column: str, expected: str) -> Column:
    return F.col(column) != F.lit(expected)


def normalized_time(column: str) -> Column:
    """``HH:MM`` with two digits, NULL when it is no time of day."""
    text = F.trim(F.col(column).cast("string"))
    shaped = F.when(text.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$"), text)
    return F.when(
        shaped.isNotNull(),
        F.concat(
            F.lpad(F.substring_index(shaped, ":", 1), 2, "0"),
            F.lit(":"),
            F.lpad(F.substring_index(shaped, ":", -1), 2, "0"),
        ),
    )


def unknown_timezones(df: DataFrame, column: str) -> DataFrame:
    """Rows whose zone is no IANA name (the zone list has some 600 entries)."""
    zones = df.sparkSession.createDataFrame([(z,) for z in sorted(available_timezones())], f"{column} string")
    return df.join(F.broadcast(zones), column, "left_anti")


def enforce(violations: DataFrame, message: str, show: int = 10) -> None:
    found = violations.limit(show).collect()
    if found:
        raise DataCheckError(f"{message}: {[tuple(r) for r in found]}")


def enforce_not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise DataCheckError(f"{what} is empty")
    return df


def vintage_rules() -> dict[str, Column]:
    return {
        **missing_values(["reference_date", "vintage_date"]),
        "vintage_before_reference": before("vintage_date", "reference_date"),
    }


def calendar_rules(name_column: str, expected: str | None = None) -> dict[str, Column]:
    columns = [name_column, "reference_date", "release_date", "release_time", "release_timezone"]
    rules = {
        **missing_values(columns),
        "release_before_reference": before("release_date", "reference_date"),
        "invalid_time": F.col("release_time").isNotNull() & normalized_time("release_time").isNull(),
    }
    if expected is not None:
        rules["unexpected_name"] = unexpected_name(name_column, expected)
    return rules


def availability_audit(prepared: DataFrame, by: str = "series_name") -> DataFrame:
    """Observations and how many became available in order, for all series at once."""
    observed = F.col("value").isNotNull()
    valid = F.col("market_date_available") >= F.col("reference_date")
    return prepared.groupBy(by).agg(
        F.count_if(observed).alias("observations"),
        F.count_if(observed & valid).alias("valid_availability"),
        F.count_if(observed & ~F.coalesce(valid, F.lit(False))).alias("invalid_availability"),
    )


def release_coverage(aligned: DataFrame, by: str = "series_name") -> DataFrame:
    """Share of non-null observations with a known release event."""
    observed = F.col("value").isNotNull()
    matched = observed & F.col("release_date").isNotNull()
    return (
        aligned.groupBy(by)
        .agg(
            F.count_if(observed).alias("non_null_observations"),
            F.count_if(matched).alias("matched_release_events"),
            F.count_if(observed & F.col("release_date").isNull()).alias("unmatched_observations"),
        )
        .withColumn("coverage_rate", ratio("matched_release_events", "non_null_observations"))
    )


def coverage_problems(aligned: DataFrame) -> DataFrame:
    return aligned.filter(F.col("value").isNotNull() & F.col("release_date").isNull())


def reference_window(prepared: DataFrame, start: str, end: str) -> DataFrame:
    return prepared.filter(
        F.col("reference_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def future_information(joined: DataFrame, day: str, available: str) -> DataFrame:
    """Rows that saw information after their own date; must be empty after an as-of join."""
    return joined.filter(F.col(available) > F.col(day))


def holdout_rows(df: DataFrame, year: int, columns: Sequence[str]) -> DataFrame:
    """Rows with any date inside the locked year."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.year(c) == year, F.lit(False))
    return df.filter(hit)


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ between two tables of the same columns, as multisets in any order.

    Columns: keys, ``left_rows``, ``right_rows`` and ``difference``: ``missing_right``, ``missing_left``,
    ``row_count``, or ``values`` (as many rows, other contents). NULL is a key and a value like any other; equal
    tables give no row. Each side adds up, per key, its number of rows and two 64-bit hashes of each row with
    the sign of its side: equal multisets cancel to zero whatever their order, and map-side sums leave
    one row a key and task, so a key that holds a large share of the rows shuffles no more than others.
    """
    columns = list(left.columns)
    require_columns(right, columns, "right side")
    unknown = sorted(set(right.columns) - set(columns))
    if unknown:
        raise DataCheckError(f"right side has other columns: {unknown}")
    # a hash passes over NULL, so which cells are NULL is hashed with the cells
    cells = [cell for c in columns for cell in (F.isnull(c), F.col(c))]

    def marked(rows: DataFrame, side: int) -> DataFrame:
        hashes = [F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)]
        signed = [(h.cast("decimal(20,0)") * F.lit(side)).cast("decimal(20,0)") for h in hashes]
        return rows.select(*keys, F.lit(side).alias("_side"), *[h.alias(f"_h{i}") for i, h in enumerate(signed)])

    met = (
        marked(left, 1)
        .unionByName(marked(right.select(*columns), -1))
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("_side") > 0).alias("left_rows"),
            F.count_if(F.col("_side") < 0).alias("right_rows"),
            F.sum("_h0").alias("_first"),
            F.sum("_h1").alias("_second"),
        )
    )
    difference = (
        F.when(F.col("right_rows") == 0, "missing_right")
        .when(F.col("left_rows") == 0, "missing_left")
        .when(F.col("left_rows") != F.col("right_rows"), "row_count")
        .when((F.col("_first") != 0) | (F.col("_second") != 0), "values")
    )
    return met.withColumn("difference", difference).filter("difference is not null").drop("_first", "_second")


def coverage_disagreements(coverage: DataFrame, problems: DataFrame, by: str = "series_name") -> DataFrame:
    """Series whose summary contradicts itself or the detail rows; must be empty.

    A summary is whole when matched and unmatched observations add up to all non-NULL ones and the
    detail holds one row for each unmatched one. A series in the detail alone is a contradiction as well.
    """
    detail = problems.groupBy(by).agg(F.count(F.lit(1)).alias("detail_rows"))
    side = detail.select(F.col(by).alias("_by"), "detail_rows")
    met = coverage.join(side, F.col(by).eqNullSafe(F.col("_by")), "full").select(
        F.when(F.col("non_null_observations").isNull(), F.col("_by")).otherwise(F.col(by)).alias(by),
        "non_null_observations",
        "matched_release_events",
        "unmatched_observations",
        F.coalesce("detail_rows", F.lit(0)).alias("detail_rows"),
    )
    whole = (F.col("matched_release_events") + F.col("unmatched_observations") == F.col("non_null_observations")) & (
        F.col("unmatched_observations") == F.col("detail_rows")
    )
    return met.filter(~F.coalesce(whole, F.lit(False)))
