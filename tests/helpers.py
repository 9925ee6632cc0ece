from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd

from tidemark.functions.catalog import MATURITIES, TERMS, YIELDS

BAR_SCHEMA = "symbol string, market_date date, open double, high double, low double, close double, volume double"


def day(text: str) -> date:
    return date.fromisoformat(text)


def days(start: str, n: int) -> list[date]:
    first = day(start)
    return [first + timedelta(days=i) for i in range(n)]


def walk(symbol: str, n: int, seed: int, start: str = "2021-01-01") -> pd.DataFrame:
    """Seeded random-walk bars of one symbol."""
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame(
        {
            "symbol": symbol,
            "market_date": days(start, n),
            "open": close * (1 + rng.normal(0, 0.004, n)),
            "high": close * 1.01,
            "low": close * 0.99,
            "close": close,
            "volume": rng.integers(1_000, 9_000, n).astype(float),
        }
    )


def bars(spark, *frames: pd.DataFrame):
    return spark.createDataFrame(pd.concat(frames), BAR_SCHEMA)


def curve_frame(spark, rows: list[list[float | None]], dates: list[date]):
    schema = "curve_date date, " + ", ".join(f"{y} double" for y in YIELDS)
    return spark.createDataFrame([(d, *r) for d, r in zip(dates, rows, strict=True)], schema)


def pandas_sorted(df, *keys: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def close_enough(a, b, tolerance: float = 1e-9) -> bool:
    a, b = pd.Series(a).astype(float).reset_index(drop=True), pd.Series(b).astype(float).reset_index(drop=True)
    if not (a.isna() == b.isna()).all():
        return False
    gap = (a - b).abs() / b.abs().clip(lower=1)
    return bool(gap.fillna(0).max() <= tolerance) if len(gap) else True


__all__ = ["MATURITIES", "TERMS", "YIELDS"]
