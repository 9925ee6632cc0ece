"""Session grids with an age limit, and legs of a measure that must all be fresh."""

import datetime as dt

import pytest

from tidemark.operators import intraday, research

DAY = dt.date(2021, 3, 9)


def at(hour, minute):
    return dt.datetime(2021, 3, 9, hour, minute)


def bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, session_date date, bar_start timestamp, close double")


def test_grid_fills_gaps_up_to_the_age_limit(spark):
    rows = [("a", DAY, at(14, 0), 1.0), ("b", DAY, at(14, 5), 2.0), ("a", DAY, at(14, 25), 1.5), ("c", DAY, at(18, 0), 9.0)]
    grid = intraday.session_grid(bars(spark, rows), {"short": "a", "long": "b"}, max_age=10)
    out = [(r.bar_start.minute, r.short, r.long) for r in grid.orderBy("bar_start").collect()]
    assert out == [(0, 1.0, None), (5, 1.0, 2.0), (10, 1.0, 2.0), (15, None, 2.0), (20, None, None), (25, 1.5, None)]


def test_values_do_not_cross_sessions(spark):
    later = dt.date(2021, 3, 10)
    rows = [("a", DAY, at(23, 55), 1.0), ("b", later, dt.datetime(2021, 3, 10, 0, 0), 2.0)]
    grid = intraday.session_grid(bars(spark, rows), {"short": "a", "long": "b"}, max_age=60)
    assert [(r.session_date, r.short, r.long) for r in grid.orderBy("bar_start").collect()] == [(DAY, 1.0, None), (later, None, 2.0)]


def test_changes_need_both_slots_fresh(spark):
    rows = [("a", DAY, at(14, 0), 4.0), ("b", DAY, at(14, 0), 4.5), ("a", DAY, at(14, 5), 4.25), ("b", DAY, at(14, 5), 4.25), ("a", DAY, at(14, 15), 4.0)]
    grid = intraday.session_grid(bars(spark, rows), {"short": "a", "long": "b"}, max_age=5)
    out = intraday.with_yield_changes(grid, ["short"], {"slope": ("short", "long")}, changes=(5, 15))
    got = [(r.bar_start.minute, r.slope_bp, r.short_chg_5m, r.short_chg_15m, r.slope_chg_5m) for r in out.orderBy("bar_start").collect()]
    assert got == [(0, 50.0, None, None, None), (5, 0.0, 25.0, None, -50.0), (10, 0.0, 0.0, None, 0.0), (15, None, -25.0, 0.0, None)]


def test_empty_grid(spark):
    assert intraday.session_grid(bars(spark, []), {"short": "a"}).count() == 0


LEGS = {"nominal_5y": ("n5", 3), "real_5y": ("r5", 1), "nominal_10y": ("n10", 3), "real_10y": ("r10", 1)}


def observed(spark, rows):
    return spark.createDataFrame([(s, dt.date(2021, 3, d), v) for s, d, v in rows], "series_name string, reference_date date, value double")


def asked(spark, *days):
    return spark.createDataFrame([(dt.date(2021, 3, d),) for d in days], "market_date date")


def test_each_leg_has_its_own_age_limit(spark):
    seen = observed(spark, [("n5", 1, 2.0), ("r5", 1, 0.5), ("n10", 1, 3.0), ("r10", 2, 1.0), ("r5", 4, None), ("other", 3, 9.0)])
    out = research.inflation_compensation(research.fresh_legs(asked(spark, 1, 2, 2, 3, 5), seen, LEGS))
    rows = {r.market_date.day: r for r in out.collect()}
    assert sorted(rows) == [1, 2, 3, 5]
    assert rows[1].inflation_compensation_5y == 1.5 and rows[1].inflation_compensation_10y is None and rows[1].forward_5y5y is None
    assert rows[2].inflation_compensation_10y == 2.0
    assert rows[2].forward_5y5y == pytest.approx(100 * (((1.02**10) / (1.015**5)) ** 0.2 - 1), abs=1e-12)
    assert rows[3].real_5y is None and rows[3].nominal_5y == 2.0 and rows[3].inflation_compensation_5y is None
    assert rows[5].nominal_5y is None and rows[5].real_10y is None


def test_two_observations_of_a_date_fail(spark):
    seen = observed(spark, [("n5", 1, 2.0), ("n5", 1, 2.0), ("r5", 1, 0.5)])
    with pytest.raises(Exception, match="two observations of a date"):
        research.fresh_legs(asked(spark, 1), seen, LEGS).collect()


def test_bases_that_are_not_positive_have_no_forward_rate(spark):
    seen = observed(spark, [("n5", 1, -150.0), ("r5", 1, 0.0), ("n10", 1, 3.0), ("r10", 1, 1.0)])
    row = research.inflation_compensation(research.fresh_legs(asked(spark, 1), seen, LEGS)).first()
    assert row.inflation_compensation_5y == -150.0 and row.forward_5y5y is None
