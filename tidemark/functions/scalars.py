"""Column helpers shared by the operators. Missing is always NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_double() -> Column:
    return F.lit(None).cast("double")


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: Column | str) -> Column:
    return F.nanvl(as_col(value), null_double())


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that yields NULL instead of an ANSI error on zero."""
    return F.try_divide(as_col(top).cast("double"), as_col(bottom).cast("double"))


def change(now: Column | str, before: Column | str) -> Column:
    return ratio(now, before) - F.lit(1.0)


def log_ratio(now: Column | str, before: Column | str) -> Column:
    """Natural logarithm of a quotient: of zero it is minus infinity, as in SQL, of less NULL."""
    quotient = ratio(now, before)
    return F.when(quotient == 0.0, F.lit(-math.inf)).otherwise(F.ln(quotient))


def flag(condition: Column) -> Column:
    """1/0 where an unknown condition counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sign_score(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def utc_date(value: Column | str) -> Column:
    """Calendar date in UTC (the session time zone is UTC)."""
    return F.to_date(as_col(value))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation that is NULL for a constant input."""
    x, y = as_col(x), as_col(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def share(condition: Column, among: Column) -> Column:
    """Mean of a boolean over rows where ``among`` is not NULL."""
    return F.avg(F.when(among.isNotNull(), condition.cast("double")))


def two_sided_normal_p(t: Column, terms: int = 200) -> Column:
    """2·(1−Φ(|t|)); meant for report rows.

    Below 3 by the all-positive series erf(z) = exp(−z²) · Σ z^(2n+1) / Γ(n+3/2); from
    there on by the continued fraction of erfc, which keeps its relative precision
    in the tail.
    """
    z = F.abs(t) / F.lit(math.sqrt(2.0))
    small = F.least(z, F.lit(3.0))
    seed = F.struct(
        (small * F.lit(2.0 / math.sqrt(math.pi))).alias("term"),
        F.lit(0.0).alias("total"),
    )
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        seed,
        lambda acc, n: F.struct(
            (acc["term"] * small * small / (n + F.lit(0.5))).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    large = F.greatest(z, F.lit(2.0))
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), large, lambda below, n: large + n / F.lit(2.0) / below)
    tail = F.exp(-large * large) / F.lit(math.sqrt(math.pi)) / fraction
    return F.when(t.isNotNull(), F.when(F.abs(t) < 3.0, F.greatest(F.lit(0.0), F.lit(1.0) - F.exp(-small * small) * series)).otherwise(tail))


def _round(value: Column, digits: int) -> Column:
    """Round as the SQL does: the scaled double to a whole number, half away from zero, and back.

    Spark's ``round`` takes the shortest decimal that denotes the double instead, and
    so turns 16.4703125, a double just below that, into 16.470313.
    """
    unit = F.lit(10.0**digits)
    scaled = F.round(value * unit) / unit
    return F.when(F.abs(scaled) < math.inf, scaled).otherwise(value)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, folding −0.0 into 0.0."""
    return df.select(
        *[
            (_round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def melt(
    df: DataFrame, keep: list[str], columns: list[str], name: str, value: str
) -> DataFrame:
    """Wide to long in one narrow step (no shuffle)."""
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    long = df.select(*keep, F.posexplode(cells).alias("_at", value))
    return long.select(*keep, F.element_at(names, F.col("_at") + 1).alias(name), value)
