"""Scans: bars, observations, vintage payloads, calendars, forecasts, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import nan_to_null
from tidemark.operators import checks

TIME_NAMES = ("datetime", "timestamp", "date", "time")
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
REPORT_DATES = ("market_date", "session_date", "trading_date", "date", "timestamp")


def read_table(spark: SparkSession, path: str, schema: str | None = None, form: str = "csv") -> DataFrame:
    """CSV or Parquet with an explicit schema where one is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    if form == "csv":
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    return reader.format(form).load(path)


def snake_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def _time_column(df: DataFrame) -> str:
    for name in TIME_NAMES:
        if name in df.columns:
            return name
    raise checks.DataCheckError("bars need a date, datetime, timestamp or time column")


def normalize_bars(raw: DataFrame, arrival: Sequence[str] = (), symbol: str | None = None) -> DataFrame:
    """Standard bar schema; of several rows with one timestamp the first to arrive stays.

    Values that are no numbers fail the query (ANSI cast). ``arrival`` orders
    rows that share a timestamp.
    """
    named = snake_names(raw)
    when = _time_column(named)
    checks.require_columns(named, PRICE_COLUMNS, "bars")
    keys = [F.col("symbol")] if "symbol" in named.columns else [F.lit(symbol or "default").alias("symbol")]
    extra = [c for c in ("vwap",) if c in named.columns]
    typed = named.select(
        *keys,
        F.col(when).cast("timestamp").alias("timestamp"),
        *[F.col(c).cast("double").alias(c) for c in (*PRICE_COLUMNS, *extra)],
        *arrival,
    )
    order = [F.col(a) for a in arrival] or [F.lit(0)]
    first = Window.partitionBy("symbol", "timestamp").orderBy(*order)
    kept = typed.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1").drop("_copy", *arrival)
    return kept.withColumn("market_date", F.to_date("timestamp"))


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of one or many CSV files in file order."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    placed = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_offset", F.monotonically_increasing_id())
    return normalize_bars(placed, ["_file", "_offset"], symbol)


def normalize_download(raw: DataFrame) -> DataFrame:
    """Six standard columns of a downloaded bar table; an empty table is an error."""
    named = snake_names(raw)
    for old in ("date", "datetime"):
        if old in named.columns:
            named = named.withColumnRenamed(old, "timestamp")
    checks.require_columns(named, ["timestamp", *PRICE_COLUMNS], "downloaded bars")
    return checks.enforce_not_empty(named.select("timestamp", *PRICE_COLUMNS), "downloaded bars")


def normalize_observations(raw: DataFrame, date: str, value: str) -> DataFrame:
    """(reference_date, value) with unreadable values as NULL."""
    return raw.select(
        F.to_date(date).alias("reference_date"),
        nan_to_null(F.expr(f"try_cast(`{value}` as double)")).alias("value"),
    )


def read_observations(
    spark: SparkSession, path: str, date: str, value: str, schema: str | None = None, form: str = "csv"
) -> DataFrame:
    """Scan of raw observations; a file without the date or value column is refused before any row is read."""
    raw = read_table(spark, path, schema, form)
    return normalize_observations(checks.require_columns(raw, [date, value], path), date, value)


def stamp_registry(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """Observations (series_name, reference_date, value) with their registry columns, in fixed order.

    A series the registry does not know is an error.
    """
    facts = registry.select("series_name", "series_id", "category", "source", "frequency", "units")
    unknown = observations.select("series_name").distinct().join(facts, "series_name", "left_anti")
    checks.enforce(unknown, "series absent from the registry")
    return observations.join(facts, "series_name").select(
        "reference_date", "value", "series_name", "series_id", "category", "source", "frequency", "units"
    )


PAYLOAD_SCHEMA = "observations array<map<string,string>>"


def vintage_events(payload: DataFrame, text: str = "payload", name: str = "series_name", series_id: str = "series_id") -> DataFrame:
    """Wide JSON vintages (``<ID>_<yyyyMMdd>`` keys) to long vintage events.

    Keys of other series are ignored; a key of this series with a malformed date,
    or an observation without date, fails the query. "." and other non-numbers
    become NULL.
    """
    parsed = payload.select(
        name, series_id, F.explode(F.from_json(F.col(text), PAYLOAD_SCHEMA)["observations"]).alias("_row")
    )
    prefix = F.concat(F.col(series_id), F.lit("_"))
    reference = F.when(
        F.element_at("_row", F.lit("date")).isNull(),
        F.raise_error(F.concat(F.lit("vintage observation without date: "), F.col(name))).cast("string"),
    ).otherwise(F.element_at("_row", F.lit("date")))
    cells = parsed.select(name, series_id, F.to_date(reference).alias("reference_date"), F.explode(F.map_entries("_row")).alias("_cell"))
    own = cells.filter(F.startswith(F.col("_cell.key"), prefix))
    suffix = F.expr(f"substring(_cell.key, length({series_id}) + 2)")
    return own.select(
        F.col(name).alias("series_name"),
        F.col(series_id).alias("series_id"),
        "reference_date",
        F.to_date(suffix, "yyyyMMdd").alias("vintage_date"),
        nan_to_null(F.expr("try_cast(_cell.value as double)")).alias("value_as_known"),
    )


# Field names of recorded forecasts.
FORECAST_SCHEMA = (
    "model string, forecast_origin string, forecast_target_date string, issued_at_utc string, "
    "horizon_trading_days int, probability_positive_return double, tmf_close double, training_base_rate double"
)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast objects, one per file, with path and SHA-256 of their source file."""
    raw = spark.read.schema(FORECAST_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    files = spark.read.format("binaryFile").load(path)
    hashes = files.select(F.col("_metadata.file_path").alias("source"), F.sha2("content", 256).alias("source_sha256"))
    return raw.withColumn("source", F.col("_metadata.file_path")).join(hashes, "source", "left").select(
        "model",
        F.to_date("forecast_origin").alias("forecast_origin"),
        F.to_date("forecast_target_date").alias("forecast_target_date"),
        F.col("issued_at_utc").alias("issued_text"),
        F.to_timestamp("issued_at_utc").alias("issued_at_utc"),
        "horizon_trading_days",
        "probability_positive_return",
        "tmf_close",
        "training_base_rate",
        "source",
        "source_sha256",
    )


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Greatest path matching the pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = files.agg(F.max("path")).first()[0]
    if found is None:
        raise checks.DataCheckError(f"no file matching {pattern} in {folder}")
    return found


def report_dates(report: DataFrame) -> DataFrame:
    """Add ``market_date`` from the first known date column.

    Plain date columns are read as dates; a ``timestamp`` must carry an offset
    and counts on the New York calendar.
    """
    for name in REPORT_DATES:
        if name not in report.columns:
            continue
        text = F.trim(F.col(name).cast("string"))
        if name != "timestamp":
            day = F.expr(f"try_to_date(substring(trim(cast(`{name}` as string)), 1, 10))")
        else:
            zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text)
            day = F.to_date(F.from_utc_timestamp(F.try_to_timestamp(zoned), "America/New_York"))
        return report.withColumn("market_date", day)
    raise checks.DataCheckError("report has no recognised date column")
