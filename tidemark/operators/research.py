"""Further documented research measures: inversion spells, growth rates, VIF, quintile spread, forecast log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change, ratio
from tidemark.operators import linear
from tidemark.operators.asof import raised_where


def inversion_spells(curve: DataFrame, spread: str, order: str = "curve_date") -> DataFrame:
    """Spells of a negative spread: start, end, observations, depth.

    One row per curve date in, so the windows are bounded by the calendar.
    """
    w = Window.partitionBy().orderBy(order)
    inverted = F.col(spread) < 0
    opens = (inverted & ~F.coalesce(F.lag(inverted, 1).over(w), F.lit(False))).cast("int")
    return (
        curve.filter(F.col(spread).isNotNull())
        .withColumn("_opens", opens)
        .withColumn("spell", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(inverted)
        .groupBy("spell")
        .agg(
            F.min(order).alias("first_date"),
            F.max(order).alias("last_date"),
            F.count(F.lit(1)).alias("observations"),
            F.min(spread).alias("deepest"),
            F.avg(spread).alias("mean_spread"),
        )
    )


def trailing_percentile(curve: DataFrame, column: str, order: str = "curve_date", rows: int = 52) -> DataFrame:
    """Share of the last ``rows`` observations at or below the current one; NULL until full."""
    w = Window.partitionBy().orderBy(order).rowsBetween(-(rows - 1), 0)
    seen = F.collect_list(column).over(w)
    below = F.size(F.filter(seen, lambda x: x <= F.col(column)))
    return curve.withColumn(
        f"{column}_percentile", F.when(F.count(column).over(w) == rows, below / F.lit(float(rows)))
    )


def growth_rates(series: DataFrame, by: Sequence[str] = ("series_name",), order: str = "reference_date", value: str = "value") -> DataFrame:
    """Year-over-year and annualised three-month growth of monthly values, matched by month."""
    month = (F.year(order) * 12 + F.month(order)).cast("long")
    w = Window.partitionBy(*by).orderBy("_month")

    def months_ago(k: int):
        return F.first(value).over(w.rangeBetween(-k, -k))

    numbered = series.withColumn("_month", month)
    return numbered.select(
        *series.columns,
        change(value, months_ago(12)).alias("yoy"),
        (F.pow(ratio(value, months_ago(3)), F.lit(4.0)) - 1).alias("annualized_3m"),
    )


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, vif) over complete rows: the diagonal of the inverse correlation matrix.

    One aggregate yields counts, means and deviations, which centre and scale the columns;
    a second yields their moment matrix, and the inverse is taken in the same job.
    """
    complete = df.select(*[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"z{i}" for i in range(len(columns))]
    facts = complete.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    scaled = complete.crossJoin(F.broadcast(facts)).select(  # one row
        F.lit("all").alias("of"), *[ratio(F.col(c) - F.col(f"{c}_mean"), f"{c}_sd").alias(c) for c in names]
    ).dropna()  # a constant column leaves no row: no table
    moments = linear.moments(scaled, "of", names)
    first = F.element_at(F.element_at("moments", 1), 1)  # the count of complete rows
    correlations = F.transform("moments", lambda row: F.transform(row, lambda x: x / first))
    labels = F.array(*[F.lit(c) for c in columns])
    both = F.arrays_zip(labels.alias("feature"), linear.inverse_diagonal(correlations).alias("vif"))
    return moments.select(F.explode(both).alias("one")).select("one.feature", "one.vif")


def quintile_spread(summary: DataFrame, keys: Sequence[str] = ("model",), ret: str = "mean_forward_return_5") -> DataFrame:
    """Top minus bottom quintile of mean return."""
    top = F.max(F.when(F.col("probability_bucket") == "Q5_highest", F.col(ret)))
    bottom = F.max(F.when(F.col("probability_bucket") == "Q1_lowest", F.col(ret)))
    return summary.groupBy(*keys).agg((top - bottom).alias("q5_minus_q1"))


def strong_forecast_hit_rate(predictions: DataFrame, keys: Sequence[str] = ("model",), forecast: str = "prediction", actual: str = "actual") -> DataFrame:
    """P(return > 0 | forecast above one standard deviation of the forecasts)."""
    spread = predictions.groupBy(*keys).agg(F.stddev_samp(forecast).alias("_sd"))
    strong = F.col(forecast) > F.col("_sd")
    return (
        predictions.join(F.broadcast(spread), list(keys))
        .groupBy(*keys)
        .agg(
            F.count_if(strong).alias("strong_forecasts"),
            F.avg(F.when(strong, (F.col(actual) > 0).cast("double"))).alias("hit_rate"),
        )
    )


def forecast_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Logged forecasts met with the value at their target time; open ones keep NULLs."""
    real = outcomes.select("symbol", F.col("market_date").alias("target_date"), F.col("close").alias("realized_close"))
    return (
        log.join(real, ["symbol", "target_date"], "left")
        .withColumn("realized_return", change("realized_close", "origin_close"))
        .withColumn("forecast_error", F.col("realized_return") - F.col("forecast_return"))
    )


def fresh_legs(
    dates: DataFrame, observations: DataFrame, legs: dict[str, tuple[str, int]],
    on: str = "market_date", series: str = "series_name", order: str = "reference_date", value: str = "value",
) -> DataFrame:
    """Last observation of every leg (name -> series, age limit in days) on or before each date.

    A leg older than its own limit is NULL; two observations of a series on one
    date are an error. One row per distinct date: the window is bounded by the calendar.
    """
    names = {of for of, _ in legs.values()}
    single = (
        observations.filter(F.col(series).isin(*names) & F.col(value).isNotNull())
        .groupBy(series, order)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v"))
        .withColumn("_v", raised_where(F.col("_n") > 1, F.col("_v"), "two observations of a date:", series, order))
    )
    wide = single.groupBy(F.col(order).alias(on)).agg(*[F.max(F.when(F.col(series) == of, F.col("_v"))).alias(leg) for leg, (of, _) in legs.items()])
    asked = dates.select(on).filter(F.col(on).isNotNull()).distinct().withColumn("_asked", F.lit(True))
    past = Window.partitionBy().orderBy(on).rowsBetween(Window.unboundedPreceding, 0)

    def fresh(leg: str, limit: int):
        age = F.datediff(on, F.last(F.when(F.col(leg).isNotNull(), F.col(on)), ignorenulls=True).over(past))
        return F.when(age <= limit, F.last(leg, ignorenulls=True).over(past)).alias(leg)

    merged = asked.join(wide, on, "full")
    return merged.select(on, "_asked", *[fresh(leg, limit) for leg, (_, limit) in legs.items()]).filter("_asked").drop("_asked")


def inflation_compensation(legs: DataFrame, maturities: Sequence[int] = (5, 10), forwards: Sequence[tuple[int, int]] = ((5, 10),), on: str = "market_date") -> DataFrame:
    """Nominal minus real yield of equal maturity, in percent, its change over five dates, and forward rates between maturities.

    ``legs`` has nominal_{m}y and real_{m}y, NULL where they are not fresh. A forward
    rate compounds: ((1 + c_b)^b / (1 + c_a)^a)^(1 / (b - a)) - 1; it is NULL where a base is not positive.
    """
    dates = Window.partitionBy().orderBy(on)  # one row per date: bounded by the calendar
    out = legs.select("*", *[(F.col(f"nominal_{m}y") - F.col(f"real_{m}y")).alias(f"inflation_compensation_{m}y") for m in maturities])

    def forward(a: int, b: int):
        near, far = (1 + F.col(f"inflation_compensation_{m}y") / 100 for m in (a, b))
        rate = F.pow(far, F.lit(b / (b - a))) / F.pow(near, F.lit(a / (b - a))) - 1
        return F.when((near > 0) & (far > 0), rate * 100).alias(f"forward_{a}y{b - a}y")

    moved = [
        ((F.col(f"inflation_compensation_{m}y") - F.lag(f"inflation_compensation_{m}y", 5).over(dates)) * 100).alias(f"inflation_compensation_{m}y_change_5d_bp")
        for m in maturities
    ]
    return out.select("*", *[forward(a, b) for a, b in forwards], *moved)
