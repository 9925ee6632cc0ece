"""Row-ordered windows over a panel, cut into bounded blocks.

A panel has one row per (key, time). Windows that look a fixed number of rows
back or ahead do not need the whole history of a key in one task: rows get a
position within their key, positions are cut into blocks, and each block
carries copies of the few neighbouring rows its windows look at. A key holding
a third of all rows is thus spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROW = "_row"
BLOCK = "_block"
BLOCK_ROWS = 1024


def index_rows(
    df: DataFrame, by: Sequence[str] = ("symbol",), order: str = "market_date", span: str = "year", tie: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based position of each row within its key.

    Positions come from counts per (key, calendar span) plus the position inside
    the span, so no task sorts more than one span of one key. Choose a finer
    ``span`` for intraday data. Rows with a NULL key form a key of their own; rows
    with a NULL time come first in theirs. ``tie`` orders the rows of one time.
    """
    by = list(by)
    spanned = df.withColumn("_span", F.date_trunc(span, F.col(order)))
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spanned.groupBy(*by, "_span")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    )
    inside = Window.partitionBy(*by, "_span").orderBy(order, *tie)
    return (
        join_null_safe(spanned.withColumn("_place", F.row_number().over(inside)), starts.drop("_size"), [*by, "_span"])
        .withColumn(ROW, F.col("_start") + F.col("_place") - 1)
        .drop("_span", "_place", "_start")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL; key columns are those of the left side."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def home_block(rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(ROW) / F.lit(rows))


def spread(df: DataFrame, back: int = 0, ahead: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign blocks and copy the ``back``/``ahead`` border rows to the neighbours."""
    if max(back, ahead) > rows:
        raise ValueError("a block must hold at least the rows its windows look at")
    home = home_block(rows)
    place = F.col(ROW) - home * F.lit(rows)
    targets = [home]
    if back:
        targets.append(F.when(place >= rows - back, home + 1))
    if ahead:
        targets.append(F.when((place < ahead) & (home > 0), home - 1))
    return df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets))))


def window(by: Sequence[str] = ("symbol",)) -> WindowSpec:
    return Window.partitionBy(*by, BLOCK).orderBy(ROW)


def is_home(rows: int = BLOCK_ROWS) -> Column:
    return F.col(BLOCK) == home_block(rows)


def settle(df: DataFrame, rows: int = BLOCK_ROWS, keep_row: bool = False) -> DataFrame:
    """Drop the copied border rows and the helper columns."""
    kept = df.filter(is_home(rows)).drop(BLOCK)
    return kept if keep_row else kept.drop(ROW)


def rolling(function, column: Column | str, rows: int, w: WindowSpec) -> Column:
    """``function`` over the last ``rows`` rows, NULL until all of them are non-NULL."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) == rows, function(column).over(frame))


def running_sum(
    df: DataFrame,
    sums: dict[str, Column],
    by: Sequence[str] = ("symbol",),
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inclusive running sums over an indexed panel: block totals, then rows inside a block."""
    by = list(by)
    homed = df.withColumn(BLOCK, home_block(rows))
    earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        homed.groupBy(*by, BLOCK)
        .agg(*[F.sum(column).alias(f"_in_{out}") for out, column in sums.items()])
        .select(
            *by,
            BLOCK,
            *[F.coalesce(F.sum(f"_in_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in sums],
        )
    )
    upto = window(by).rowsBetween(Window.unboundedPreceding, 0)
    return join_null_safe(homed, before, [*by, BLOCK]).select(
        *df.columns,
        *[(F.col(f"_before_{out}") + F.sum(column).over(upto)).alias(out) for out, column in sums.items()],
    )
