"""Structured Streaming forms: five-minute bars and forecast outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intraday import BAR_MINUTES, bars_from_ticks

LATE = "10 minutes"


def read_ticks(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def streaming_bars(ticks: DataFrame, late: str = LATE, minutes: int = BAR_MINUTES) -> DataFrame:
    """Bars that are emitted once their slot is older than the watermark; later ticks are dropped."""
    return bars_from_ticks(ticks.withWatermark("ts", late), minutes)


def streaming_outcomes(log: DataFrame, outcomes: DataFrame, late: str = LATE, wait: str = "7 days") -> DataFrame:
    """Stream-stream join of forecasts (symbol, target_ts) with realised closes (symbol, ts).

    State of either side is dropped once the watermark passes the wait.
    """
    left = log.withWatermark("target_ts", late)
    right = outcomes.select(F.col("symbol").alias("_symbol"), "ts", F.col("close").alias("realized_close")).withWatermark("ts", late)
    joined = left.join(
        right,
        (F.col("symbol") == F.col("_symbol"))
        & (F.col("ts") >= F.col("target_ts"))
        & (F.col("ts") <= F.col("target_ts") + F.expr(f"interval {wait}"))
        & (F.col("ts") == F.col("target_ts")),
        "inner",
    )
    return joined.drop("_symbol", "ts").withColumn(
        "forecast_error", F.col("realized_close") / F.col("origin_close") - 1 - F.col("forecast_return")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now into a Parquet table (exactly-once file sink)."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
