"""Exponential smoothing y_t = r·y_(t−1) + (1−r)·x_t as native window sums.

Blocks are cut into parts short enough for r^(−part) to stay finite. Inside a part
the recurrence is a running sum of x·r^(−position) scaled back by r^position; parts
are linked by their end states, a table with one row per part. A part takes over
all earlier states that still weigh anything in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel


#: Natural logarithm of the largest scale used: products with prices stay finite, smaller weights are nothing.
_RANGE = 460.0


@dataclass(frozen=True)
class Smooth:
    """``out`` = exponential mean of ``source`` with weight ``alpha``, seeded at row ``seed``."""

    out: str
    source: str
    alpha: float
    seed: int = 0


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def _power(base: float, exponent: Column) -> Column:
    return F.exp(exponent * F.lit(math.log(base)))


def part_rows(alphas: Sequence[float], rows: int) -> int:
    """Longest divisor of ``rows`` over which no smoothing's r^(−n) leaves the range of doubles."""
    least = min(1 - a for a in alphas)
    most = rows if least <= 0 else int(_RANGE / max(-math.log(least), _RANGE / rows))
    return max(n for n in range(1, rows + 1) if rows % n == 0 and n <= max(1, most))


def smooth(
    frame: DataFrame, specs: Sequence[Smooth], by: Sequence[str] = ("symbol",), rows: int = panel.BLOCK_ROWS
) -> DataFrame:
    """Add smoothed columns to a frame made by ``panel.spread`` (NULL on copied rows).

    ``alpha`` lies above 0 and up to 1 (1: the source itself).
    """
    by = list(by)
    home = panel.is_home(rows)
    slow = [s for s in specs if s.alpha < 1]
    n = part_rows([s.alpha for s in slow], rows) if slow else rows
    cut = frame.withColumn("_part", F.floor(F.col(panel.ROW) / n))
    place = F.col(panel.ROW) - F.col("_part") * F.lit(n)

    def weighted(spec: Smooth) -> Column:
        weight = (
            F.when(F.col(panel.ROW) == spec.seed, F.lit(1.0))
            .when(F.col(panel.ROW) > spec.seed, F.lit(spec.alpha))
            .otherwise(F.lit(0.0))
        )
        return F.when(home, F.coalesce(weight * F.col(spec.source), F.lit(0.0)))

    own = [
        F.when(home & (F.col(panel.ROW) >= s.seed), F.coalesce(F.col(s.source), F.lit(0.0))).alias(s.out) for s in specs if s.alpha >= 1
    ]
    if not slow:
        return cut.select(*frame.columns, *own)
    ends = cut.filter(home).groupBy(*by, "_part").agg(
        *[F.sum(weighted(s) * _power(1 - s.alpha, F.lit(n - 1) - place)).alias(f"_end_{s.out}") for s in slow]
    )
    chain = Window.partitionBy(*by).orderBy("_part")

    def carried(spec: Smooth) -> Column:
        """End state of the part before: every end still felt, the oldest first."""
        reach = math.ceil(_RANGE / (-math.log(1 - spec.alpha) * n))
        felt = F.collect_list(f"_end_{spec.out}").over(chain.rowsBetween(-min(reach, 2**31 - 1), -1))
        return F.aggregate(felt, F.lit(0.0), lambda state, end: state * F.lit((1 - spec.alpha) ** n) + end)

    states = ends.select(*by, "_part", *[carried(s).alias(f"_carry_{s.out}") for s in slow])
    upto = Window.partitionBy(*by, panel.BLOCK, "_part").orderBy(panel.ROW).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(
        "*",
        *[F.sum(weighted(s) * _power(1 - s.alpha, -place)).over(upto).alias(f"_sum_{s.out}") for s in slow],
    )
    joined = panel.join_null_safe(local, states, [*by, "_part"], "left")
    made = {
        s.out: F.when(
            home & (F.col(panel.ROW) >= s.seed),
            F.col(f"_sum_{s.out}") * _power(1 - s.alpha, place) + F.col(f"_carry_{s.out}") * _power(1 - s.alpha, place + 1),
        )
        for s in slow
    }
    fast = dict(zip([s.out for s in specs if s.alpha >= 1], own))
    return joined.select(*frame.columns, *[made[s.out].alias(s.out) if s.out in made else fast[s.out] for s in specs])


def rsi(gain: str, loss: str) -> Column:
    """Relative strength index from smoothed gain and loss; NULL when both are zero."""
    g, l = F.col(gain), F.col(loss)
    strength = F.try_divide(g, l)
    return F.when(l == 0, F.when(g > 0, F.lit(100.0))).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + strength)
    )
