"""Forecasts met with same-day report rows; read-only by construction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.operators.asof import HIT, dates_asof, join_by_key

HORIZON_ROWS = 5
TRADING_STATUS = "NOT_AUTHORIZED_READ_ONLY"


def forecast_violations(forecasts: DataFrame, model: str, zoned: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Contract of a recorded forecast. ``zoned`` names the raw issue-time text to check for an offset."""
    p = F.col("probability_positive_return")
    rules = {
        "model": ~F.col("model").eqNullSafe(model),
        "horizon": ~F.col("horizon_trading_days").eqNullSafe(HORIZON_ROWS),
        "target_after_origin": ~F.coalesce(F.col("forecast_target_date") > F.col("forecast_origin"), F.lit(False)),
        "probability": ~F.coalesce(~F.isnan(p) & p.between(0, 1), F.lit(False)),
    }
    if zoned is not None:
        rules["issue_time_zone"] = ~F.coalesce(F.col(zoned).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))
    return checks.row_violations(forecasts, rules, [*by, "forecast_origin", "model"])


def report_status(
    forecasts: DataFrame, report: DataFrame, schema_ok: bool = True, available: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Per forecast origin (and ``by``, a key of forecasts and report): does the report hold exactly one row of that day?

    A stale row is never substituted; the newest earlier date is only named.
    ``report`` has ``market_date`` and any state columns, returned in ``data``.
    """
    by = list(by)
    origins = forecasts.select(*by, F.col("forecast_origin").alias("as_of")).distinct()
    if not available or not schema_ok:
        word = "unavailable" if not available else "invalid_schema"
        return origins.select(
            *by,
            "as_of",
            F.lit(word).alias("status"),
            F.lit(None).cast("date").alias("latest_available_as_of"),
            F.lit(None).cast("string").alias("data"),
        )
    fields = [c for c in report.columns if c not in {"market_date", *by}]
    per_day = report.groupBy(*by, "market_date").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(F.to_json(F.struct(*[F.col(c) for c in fields]) if fields else F.struct(F.lit(1)))).alias("_data"),
    )
    facts = ["_rows", "_data"]
    if by:
        keyed = join_by_key(origins, per_day, by, "as_of", "market_date", facts, unit="year")
        found = keyed.select(*by, "as_of", F.struct("market_date", *facts).alias(HIT))
    else:
        found = dates_asof(origins, "as_of", per_day, "market_date", facts)
    bad = report.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("market_date").isNull()).alias("_undated"))
    same = F.col(f"{HIT}.market_date") == F.col("as_of")
    status = (
        F.when(F.col("_all") == 0, "empty")
        .when(F.col("_undated") > 0, "invalid_schema")
        .when(same & (F.col(f"{HIT}._rows") > 1), "ambiguous_duplicate_date")
        .when(same, "matched")
        .otherwise("date_mismatch")
    )
    return (
        found.crossJoin(F.broadcast(bad))
        .withColumn("status", status)
        .select(
            *by,
            "as_of",
            "status",
            F.when(F.col("status") == "date_mismatch", F.col(f"{HIT}.market_date")).alias("latest_available_as_of"),
            F.when(F.col("status") == "matched", F.col(f"{HIT}._data")).alias("data"),
        )
    )


def assess(forecasts: DataFrame, reports: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Forecast rows with the status of each report and the all-aligned flag."""
    out = forecasts
    aligned = F.lit(True)
    for name, report in reports.items():
        status = report_status(forecasts, report, by=by).select(
            *by,
            F.col("as_of").alias("forecast_origin"),
            F.struct("status", "latest_available_as_of", "data").alias(name),
        )
        out = out.join(status, [*by, "forecast_origin"], "left")
        aligned = aligned & (F.col(f"{name}.status") == "matched")
    return out.select(
        "*",
        aligned.alias("all_assessments_date_aligned"),
        F.struct(F.lit(TRADING_STATUS).alias("status"), F.lit(False).alias("orders_generated")).alias("trading"),
    )
