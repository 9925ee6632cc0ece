"""Chronological splits with targets purged at every boundary."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.operators.checks import require_order, require_positive

#: Partition column of panels that folds are cut from: the year of the row's date.
YEAR = "market_year"

# Fixed values: (name, train start, train end, validation start, validation end).
DEFAULT_FOLDS = (
    ("fold_1", "2021-10-04", "2022-12-31", "2023-01-01", "2023-12-31"),
    ("fold_2", "2021-10-04", "2023-12-31", "2024-01-01", "2024-12-31"),
    ("fold_3", "2021-10-04", "2024-12-31", "2025-01-01", "2025-12-31"),
)


def yearly_folds(start: str, validation_years: Sequence[int]) -> tuple[tuple[str, ...], ...]:
    """Expanding folds: train from ``start`` up to each validation year."""
    return tuple(
        (f"fold_{i}", start, f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31")
        for i, y in enumerate(validation_years, 1)
    )


def with_target_end(
    df: DataFrame, horizon: int, by: Sequence[str] = ("symbol",), order: str = "market_date"
) -> DataFrame:
    """Date of the row ``horizon`` rows ahead: where the forward target ends."""
    require_positive("horizon", horizon)
    frame = panel.spread(panel.index_rows(df, by, order), ahead=horizon)
    ahead = F.lead(order, horizon).over(panel.window(by))
    return panel.settle(frame.withColumn("target_end_date", ahead))


def _day(value: str):
    return F.lit(value).cast("date")


def _inside(start, end, order: str):
    return (F.col(order) >= start) & (F.col(order) <= end) & (F.col("target_end_date") <= end)


def purged_range(df: DataFrame, start: str, end: str, order: str = "market_date") -> DataFrame:
    """Rows whose date and target both lie in the range. Needs ``target_end_date``."""
    require_order("range", date.fromisoformat(start), date.fromisoformat(end))
    return df.filter(_inside(_day(start), _day(end), order))


def purged_pair(df: DataFrame, fold: Sequence[str], order: str = "market_date") -> DataFrame:
    """Train and validation rows of one fold, told apart by ``role``."""
    return assign_folds(df, [fold], order)


def assign_folds(df: DataFrame, folds: Sequence[Sequence[str]] = DEFAULT_FOLDS, order: str = "market_date") -> DataFrame:
    """One frame for all folds: a row appears once per (fold, role) it belongs to.

    Every (fold, role) is a date range of its own scan, nothing is copied: a filter on
    fold and role leaves one scan, and a panel partitioned by ``YEAR`` is read in the
    years of the range only.
    """
    for _, train_start, train_end, start, end in folds:
        require_order("training", date.fromisoformat(train_start), date.fromisoformat(train_end))
        require_order("fold", date.fromisoformat(train_end), date.fromisoformat(start), strict=True)
        require_order("validation", date.fromisoformat(start), date.fromisoformat(end))
    ranges = []
    for name, train_start, train_end, start, end in folds:
        for role, a, b in (("train", train_start, train_end), ("validation", start, end)):
            rows = df.filter(_inside(_day(a), _day(b), order))
            if YEAR in df.columns:
                rows = rows.filter(F.col(YEAR).between(int(a[:4]), int(b[:4])))
            ranges.append(rows.select(F.lit(name).alias("fold"), F.lit(role).alias("role"), *[c for c in df.columns if c != YEAR]))
    return reduce(DataFrame.unionByName, ranges)


def chronological_split(df: DataFrame, cut: str, order: str = "market_date") -> DataFrame:
    """``role`` column: development before the cut, test from it on."""
    return df.withColumn("role", F.when(F.col(order) < _day(cut), "development").otherwise("test"))


def development_rows(df: DataFrame, end: str, order: str = "market_date") -> DataFrame:
    return df.filter(F.col(order) <= _day(end))


def purged_development(df: DataFrame, end: str, order: str = "market_date") -> DataFrame:
    """Rows with date and target end both inside the development period."""
    return df.filter((F.col(order) <= _day(end)) & (F.col("target_end_date") <= _day(end)))
