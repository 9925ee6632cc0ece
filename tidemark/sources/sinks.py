"""Sinks: partitioned tables, small reports, create-only JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, one directory per value of ``by``; rows of one value may use several files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet in the order of ``keys``: files, by name, hold ranges of the keys, and rows are sorted within.

    The sort partitions by sampled ranges, so no task holds the whole; NULL keys come first. Rows
    that agree on all keys may come in any order.
    """
    df.orderBy(*keys).write.mode("overwrite").parquet(path)


def write_series_table(df: DataFrame, path: str) -> None:
    """Calendars and raw observations: one partition per series."""
    write_table(df, path, ["series_name"])


def write_report(df: DataFrame, path: str) -> None:
    """CSV with header, for report tables of a few rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_once(df: DataFrame, path: str) -> None:
    """JSON that refuses to replace an existing result."""
    df.write.mode("errorifexists").json(path)
