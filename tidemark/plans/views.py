"""The panels derived from the test tables; the same definitions exist as SQL in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.catalog import YIELDS
from tidemark.operators import panel
from tidemark.session import materialize, materialized, state_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _kept(spark: SparkSession, folder: str, name: str, build, partition: str | None = None) -> DataFrame:
    """A derived panel is written once per application: several plan branches read it."""
    key = f"{folder}#{state_of(spark, folder)}#{name}"
    known = materialized(spark, key)
    return known if known is not None else materialize(build(spark, folder), key, partition)


def _bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return (
        orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("market_date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "bars_daily", _bars_daily)


def _bars_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return panel.index_rows(bars_daily(spark, folder))


def bars_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with their row position, indexed once for all windowed features."""
    return _kept(spark, folder, "bars_indexed", _bars_indexed)


def curve_long(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (week, slot): slots play the ten maturities."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.to_date(F.date_trunc("week", "l_shipdate")).alias("curve_date"),
            (F.col("l_suppkey") % 10).cast("int").alias("slot"),
        )
        # whole hundredths add up exactly in any order: equal averages are equal doubles
        .agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1))).alias("value"))
    )


def _yield_curve(spark: SparkSession, folder: str) -> DataFrame:
    return (
        curve_long(spark, folder)
        .groupBy("curve_date")
        .pivot("slot", list(range(10)))
        .agg(F.first("value"))
        .toDF("curve_date", *YIELDS)
    )


def yield_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "yield_curve", _yield_curve)


def _vintage_sums(spark: SparkSession, folder: str, clean: bool) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    if clean:
        joined = joined.filter(F.col("l_shipdate") >= F.col("o_orderdate"))
    return joined.groupBy(
        F.col("o_orderpriority").alias("series_name"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("reference_date"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("vintage_date"),
    ).agg(F.sum("l_extendedprice").alias("_flow"))


def _vintages(spark: SparkSession, folder: str) -> DataFrame:
    # at most one row per calendar month in each (series, reference) window
    months = Window.partitionBy("series_name", "reference_date").orderBy("vintage_date")
    return _vintage_sums(spark, folder, True).select(
        "series_name",
        F.concat(F.lit("S"), F.substring("series_name", 1, 1)).alias("series_id"),
        "reference_date",
        "vintage_date",
        F.round(F.sum("_flow").over(months.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("value_as_known"),
    )


def vintages(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, "vintages", _vintages)


def vintages_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Vintages that violate the date order: the negative case of the checks."""
    return _vintage_sums(spark, folder, False).select(
        "series_name",
        F.concat(F.lit("S"), F.substring("series_name", 1, 1)).alias("series_id"),
        "reference_date",
        "vintage_date",
        F.round("_flow", 2).alias("value_as_known"),
    )


def release_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return (
        vintages(spark, folder)
        .groupBy("series_name", "reference_date")
        .agg(F.min("vintage_date").alias("release_date"))
        .select(
            "series_name",
            "reference_date",
            "release_date",
            F.lit("08:30").alias("release_time"),
            F.lit("America/New_York").alias("release_timezone"),
        )
    )


def event_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """One event per vintage month of each series: the newest reference it published."""
    return (
        vintages(spark, folder)
        .groupBy("series_name", F.col("vintage_date").alias("release_date"))
        .agg(F.max("reference_date").alias("reference_date"))
        .select(
            "series_name",
            F.lit("monthly_report").alias("event_name"),
            "reference_date",
            "release_date",
            F.lit("08:30").alias("release_time"),
            F.lit("America/New_York").alias("release_timezone"),
        )
    )
