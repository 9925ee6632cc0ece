"""Backward as-of joins: exact match, carry-forward, no future rows, both strategies equal."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_enough, curve_frame, day, days, pandas_sorted
from pyspark.sql import functions as F

from tidemark.operators import asof, checks, curve

MARKET = "symbol string, market_date date, close double"


def market(spark, *dates):
    return spark.createDataFrame([(s, day(d), 1.0) for s in ("X", "Y") for d in dates], MARKET)


def test_curve_carries_forward_with_its_age(spark):
    bars = market(spark, "2026-01-01", "2026-01-02", "2026-01-05", "2026-01-06")
    rows = curve_frame(spark, [[4.0] * 10, [5.0] * 10], [day("2026-01-02"), day("2026-01-06")])
    got = pandas_sorted(asof.attach_curve(bars, curve.nelson_siegel_fit(rows)), "symbol", "market_date")
    for _, one in got.groupby("symbol"):
        one = one.reset_index(drop=True)
        assert pd.isna(one.yield_10y[0]) and one.yield_10y[1:].tolist() == [4.0, 4.0, 5.0]
        assert one.treasury_data_age_days[1:].tolist() == [0, 3, 0]
        assert one.treasury_observation_date[2] == day("2026-01-02")
    assert checks.future_information(asof.attach_curve(bars, rows), "market_date", "treasury_observation_date").isEmpty()


def macro(spark, rows):
    return spark.createDataFrame(
        [("payrolls", day(r), v, day(a) if a else None) for r, v, a in rows],
        "series_name string, reference_date date, value double, market_date_available date",
    )


def test_same_day_release_keeps_newest_reference_and_skips_nulls(spark):
    prepared = macro(spark, [("2014-05-01", 72.5, "2014-07-09"), ("2014-04-01", 71.0, "2014-07-09"),
                             ("2014-06-01", None, "2014-07-10"), ("2014-03-01", 70.25, "2014-06-03")])
    bars = market(spark, "2014-06-02", "2014-06-03", "2014-07-08", "2014-07-09", "2014-07-14")
    got = pandas_sorted(asof.attach_macro_series(bars, prepared, "payrolls"), "symbol", "market_date")[:5]
    assert got.payrolls.fillna(-1).tolist() == [-1, 70.25, 70.25, 72.5, 72.5]
    assert got.payrolls_reference_date[3] == day("2014-05-01")
    assert got.payrolls_data_age_days[1:].tolist() == [0, 35, 0, 5]
    family = pandas_sorted(asof.attach_macro_family(bars, prepared, ["payrolls", "absent"]), "symbol", "market_date")[:5]
    assert family.payrolls.fillna(-1).tolist() == got.payrolls.fillna(-1).tolist()
    assert family.payrolls_data_age_days[1:].tolist() == [0, 35, 0, 5]
    assert family.absent.isna().all()


def test_empty_series_gives_typed_nulls(spark):
    got = asof.attach_macro_series(market(spark, "2026-01-02"), macro(spark, []), "cpi")
    assert dict(got.dtypes)["cpi"] == "double" and dict(got.dtypes)["cpi_reference_date"] == "date"
    assert got.filter(F.col("cpi").isNotNull()).isEmpty() and got.count() == 2


def test_future_row_is_never_visible(spark):
    prepared = macro(spark, [("2026-01-01", 1.0, "2026-02-06")])
    got = asof.attach_macro_series(market(spark, "2026-02-05", "2026-02-06"), prepared, "x").toPandas()
    assert got[got.market_date == day("2026-02-05")].x.isna().all()
    assert (got[got.market_date == day("2026-02-06")].x == 1).all()


def test_event_merge(spark):
    events = spark.createDataFrame(
        [(day("2025-10-03"), 100.0), (day("2025-11-07"), 120.0)], "event_release_date date, payroll_level double"
    )
    got = pandas_sorted(asof.attach_events(market(spark, "2025-10-02", "2025-10-03", "2025-10-06", "2025-11-07"), events), "symbol", "market_date")[:4]
    assert got.payroll_level.fillna(0).tolist() == [0, 100, 100, 120]
    assert got.days_since_payroll_release[1:].tolist() == [0, 3, 0]
    assert got.payroll_release_day.tolist() == [0, 1, 0, 1]


def test_both_strategies_equal_merge_asof(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"market_date": rng.choice(days("2023-01-01", 700), 900), "symbol": rng.choice(["a", "b"], 900, p=[0.9, 0.1]), "id": range(900)})
    right = pd.DataFrame({"obs_date": rng.choice(days("2023-02-01", 650), 80, replace=False), "v": rng.normal(size=80)})
    both = right.merge(pd.DataFrame({"symbol": ["a", "b"]}), how="cross")
    ldf = spark.createDataFrame(left, "market_date date, symbol string, id long")
    one = asof.join_by_calendar(ldf, spark.createDataFrame(right, "obs_date date, v double"), "market_date", "obs_date", ["v"])
    two = asof.join_by_key(ldf, spark.createDataFrame(both, "obs_date date, v double, symbol string"), ["symbol"], "market_date", "obs_date", ["v"], unit="week")
    want = pd.merge_asof(
        left.assign(t=pd.to_datetime(left.market_date)).sort_values("t"),
        right.assign(t=pd.to_datetime(right.obs_date)).sort_values("t"), on="t",
    ).sort_values("id")
    for got in (one, two):
        got = pandas_sorted(got, "id")
        assert len(got) == 900 and close_enough(got.v, want.v, 0)
        assert (got.obs_date.fillna(0).tolist() == want.obs_date.fillna(0).tolist())


def test_keyed_ties_take_the_greatest(spark):
    left = spark.createDataFrame([("a", day("2024-01-05"))], "symbol string, market_date date")
    right = spark.createDataFrame([("a", day("2024-01-03"), 1, "old"), ("a", day("2024-01-03"), 2, "new")], "symbol string, at date, seq int, v string")
    assert asof.join_by_key(left, right, ["symbol"], "market_date", "at", ["v"], tie="seq").first().v == "new"


def test_contracts_raise_in_the_plan_that_joins(spark):
    """Duplicate curve, release and reference dates and late availability fail the query that would use them."""
    bars = market(spark, "2014-06-02", "2014-06-09")
    twice = spark.createDataFrame([(day("2014-06-01"), 1.0), (day("2014-06-01"), 1.0)], "curve_date date, yield_2y double")
    with pytest.raises(Exception, match="the curve has several rows of one curve_date: 2014-06-01"):
        asof.attach_curve(bars, twice).collect()
    events = spark.createDataFrame([(day("2014-06-03"), 1.0), (day("2014-06-03"), 2.0)], "event_release_date date, payroll_level double")
    with pytest.raises(Exception, match="the release events has several rows"):
        asof.attach_events(bars, events).collect()
    again = macro(spark, [("2014-04-01", 1.0, "2014-06-03"), ("2014-04-01", 2.0, "2014-06-05")])
    early = macro(spark, [("2014-06-04", 1.0, "2014-06-03")])
    for join in (lambda m: asof.attach_macro_series(bars, m, "payrolls"), lambda m: asof.attach_macro_family(bars, m, ["payrolls"])):
        with pytest.raises(Exception, match="several rows of one key"):
            join(again).collect()
        with pytest.raises(Exception, match="available before its reference date: 2014-06-04 2014-06-03"):
            join(early).collect()
    # a null observation carries no information: neither rule looks at it
    hollow = macro(spark, [("2014-04-01", 1.0, "2014-06-03"), ("2014-04-01", None, "2014-06-05"), ("2014-06-04", None, "2014-06-03")])
    assert asof.attach_macro_series(bars, hollow, "payrolls").filter("payrolls = 1").count() > 0


def test_raw_observations_are_renamed(spark):
    """Observations without a date of availability lose their nulls and nothing else."""
    raw = spark.createDataFrame([("a", day("2024-01-01"), 1.5), ("a", day("2024-02-01"), None)], "series_name string, reference_date date, value double")
    got = asof.macro_columns("macro", raw)
    assert got.columns == ["macro", "macro_reference_date"]
    assert [tuple(r) for r in got.collect()] == [(1.5, day("2024-01-01"))]
