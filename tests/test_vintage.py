"""Bitemporal scenarios, release calendars and event features."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_enough, day, pandas_sorted
from pyspark.sql import functions as F

from tidemark.functions.catalog import EMPLOYMENT_SERIES
from tidemark.operators import calendars, checks, payroll, vintage
from tidemark.plans import views

PAY = "nonfarm_payrolls"
SCHEMA = "series_name string, series_id string, reference_date date, vintage_date date, value_as_known double"
# three months: the first is revised twice, the second once
STORY = [
    ("2013-02-01", "2013-03-07", 50210.0), ("2013-02-01", "2013-04-11", 50340.0), ("2013-02-01", "2013-05-09", 50290.0),
    ("2013-03-01", "2013-04-11", 50500.0), ("2013-03-01", "2013-05-09", 50460.0), ("2013-04-01", "2013-05-09", 50720.0),
]
# a month whose first value arrives together with the next one
SHUTDOWN = [
    ("2013-09-01", "2013-10-30", 61000.0), ("2013-09-01", "2013-12-18", 60970.0),
    ("2013-10-01", "2013-12-18", 61110.0), ("2013-11-01", "2013-12-18", 61240.0),
]
CALENDAR = "series_name string, event_name string, reference_date date, release_date date, release_time string, release_timezone string"


def events(spark, story, name=PAY):
    return spark.createDataFrame([(name, "PAYEMS", day(r), day(v), x) for r, v, x in story], SCHEMA)


def calendar(spark, rows, name=PAY):
    return spark.createDataFrame(
        [(name, "employment_situation", day(r), day(d), "08:30", "America/New_York") for r, d in rows], CALENDAR
    )


def known(spark, as_of):
    rows = vintage.reconstruct_as_of(events(spark, STORY), as_of).orderBy("reference_date").collect()
    return [r.value_as_known for r in rows]


def test_reconstruction_never_sees_later_revisions(spark):
    assert known(spark, "2013-03-06") == []
    assert known(spark, "2013-03-07") == [50210.0]
    assert known(spark, "2013-04-11") == [50340.0, 50500.0]
    assert known(spark, "2013-05-08") == [50340.0, 50500.0]
    assert known(spark, "2013-11-30") == [50290.0, 50460.0, 50720.0]


def test_latest_period(spark):
    row = vintage.latest_period_as_of(events(spark, STORY), "2013-05-01").first()
    assert (row.reference_date, row.value_as_known) == (day("2013-03-01"), 50500.0)


def test_states_for_many_dates_equal_one_by_one(spark):
    dates = ["2013-02-20", "2013-03-07", "2013-04-25", "2013-05-09", "2014-06-01"]
    frame = spark.createDataFrame([(PAY, day(d)) for d in dates], "series_name string, as_of_date date")
    got = vintage.states_as_of(events(spark, STORY), frame).toPandas()
    for d in dates:
        mine = got[got.as_of_date == day(d)].sort_values("reference_date").value_as_known.tolist()
        assert mine == known(spark, d)


def test_history_columns(spark):
    got = pandas_sorted(vintage.with_history(events(spark, STORY)), "reference_date", "vintage_date")
    assert got.is_initial_release.tolist() == [True, False, False, True, False, True]
    assert got.previous_value[1] == 50210.0 and got.known_until[0] == day("2013-04-11")


def test_event_features_of_the_story(spark):
    data = events(spark, STORY)
    dates = spark.createDataFrame([(PAY, day(d)) for d in ("2013-03-07", "2013-04-11", "2013-05-09", "2013-06-01")], "series_name string, event_date date")
    got = pandas_sorted(payroll.event_features(data, dates), "event_date")
    assert got.payroll_level.tolist() == [50210, 50500, 50720, 50720]
    assert got.payroll_change_1m.fillna(-1).tolist() == [-1, 50500 - 50340, 50720 - 50460, 50720 - 50460]
    assert got.payroll_revision_1m.tolist() == [0, 130, -40, 0]
    assert got.payroll_revision_2m.tolist() == [0, 0, -50, 0]
    assert got.payroll_revision_total.tolist() == [0, 130, -90, 0]
    assert got.payroll_initial_periods.tolist() == [1, 1, 1, 0]
    assert got.payroll_revised_periods.tolist() == [0, 1, 2, 0]


def test_two_initial_periods_in_one_event(spark):
    dates = spark.createDataFrame([(PAY, day("2013-12-18"))], "series_name string, event_date date")
    row = payroll.event_features(events(spark, SHUTDOWN), dates).first()
    assert row.reference_date == day("2013-11-01") and row.payroll_change_1m == 61240 - 61110
    assert (row.payroll_revision_1m, row.payroll_revision_2m) == (-30, 0)
    assert (row.payroll_initial_periods, row.payroll_revised_periods, row.payroll_broad_revision_event) == (2, 1, 0)


def test_broad_event(spark):
    story = [(f"2020-0{m}-01", f"2020-0{m + 1}-05", 100.0 * m) for m in range(1, 6)]
    story += [(f"2020-0{m}-01", "2020-09-04", 101.0 * m) for m in range(1, 4)]
    rows = {r.event_date: r for r in payroll.event_breadth(events(spark, story)).collect()}
    assert rows[day("2020-09-04")].payroll_revised_periods == 3
    assert rows[day("2020-09-04")].payroll_broad_revision_event == 1
    rev = payroll.event_revisions(events(spark, story)).first()
    assert (rev.payroll_revision_1m, rev.payroll_revision_2m) == (3.0, 2.0)


def test_event_features_equal_brute_force(spark, folder):
    """All events of the derived vintages against a per-event loop."""
    data = views.vintages(spark, folder)
    raw = data.toPandas()
    dates = data.select("series_name", F.col("vintage_date").alias("event_date")).distinct()
    got = payroll.event_features(data, dates).toPandas().set_index(["series_name", "event_date"])
    for (name, at), row in got.iterrows():
        mine = raw[raw.series_name == name]
        past = mine[mine.vintage_date <= at].sort_values("vintage_date").groupby("reference_date").value_as_known.last().sort_index()
        assert row.reference_date == past.index[-1] and row.payroll_level == pytest.approx(past.iloc[-1])
        if len(past) > 1:
            assert row.payroll_change_1m == pytest.approx(past.iloc[-1] - past.iloc[-2])
        else:
            assert pd.isna(row.payroll_change_1m)
        revised = []
        for r in mine[mine.vintage_date == at].itertuples():
            before = mine[(mine.reference_date == r.reference_date) & (mine.vintage_date < at)].sort_values("vintage_date")
            if len(before):
                revised.append((r.reference_date, r.value_as_known - before.value_as_known.iloc[-1]))
        revised.sort(reverse=True)
        want = [v for _, v in revised[:2]] + [0.0, 0.0]
        assert row.payroll_revision_1m == pytest.approx(want[0]) and row.payroll_revision_2m == pytest.approx(want[1])
        assert row.payroll_revised_periods == len(revised)


def test_prior_only_zscores(spark):
    rows = [("s", day(f"2022-0{i}-01"), c, r, b) for i, c, r, b in
            [(1, 35.0, -4.0, 0), (2, 62.0, 9.0, 0), (3, 41.0, 555.0, 1), (4, 80.0, 14.5, 0)]]
    data = spark.createDataFrame(rows, "series_name string, event_release_date date, payroll_change_1m double, payroll_revision_total double, payroll_broad_revision_event int")
    got = pandas_sorted(payroll.with_zscores(data, 2), "event_release_date")
    assert got.payroll_change_z[:2].isna().all()
    assert got.payroll_change_z[2] == pytest.approx((41 - 48.5) / np.std([35, 62], ddof=1))
    assert pd.isna(got.payroll_revision_z[2])
    assert got.payroll_revision_z[3] == pytest.approx((14.5 - 2.5) / np.std([-4, 9], ddof=1))
    with pytest.raises(checks.DataCheckError):
        payroll.with_zscores(data, 1)
    flat = data.withColumn("payroll_change_1m", F.lit(5.0))
    assert payroll.with_zscores(flat, 2).toPandas().payroll_change_z.isna().all()


def test_event_history_is_fail_closed(spark):
    dates = [("2013-02-01", "2013-03-07"), ("2013-03-01", "2013-04-11"), ("2013-04-01", "2013-05-09")]
    got = pandas_sorted(payroll.event_history(events(spark, STORY), calendar(spark, dates)), "event_release_date")
    assert len(got) == 3 and got.event_reference_date.tolist() == [day(r) for r, _ in dates]
    with pytest.raises(checks.DataCheckError, match="without any known history"):
        payroll.event_history(events(spark, STORY), calendar(spark, [("2013-01-01", "2013-02-07")]))
    with pytest.raises(checks.DataCheckError, match="duplicate"):
        payroll.event_history(events(spark, STORY), calendar(spark, dates[:1] * 2))
    assert payroll.event_history(events(spark, STORY), calendar(spark, [])).count() == 0


def test_canonical_events(spark):
    cal = calendar(spark, [("2013-02-01", "2013-03-07"), ("2013-03-01", "2013-04-11"), ("2013-04-01", "2013-05-09")])
    got = pandas_sorted(vintage.attach_release_calendar(events(spark, STORY), cal), "reference_date", "vintage_date")
    assert got.release_time.notna().tolist() == [True, False, False, True, False, True]
    assert got.market_date_available.tolist() == got.vintage_date.tolist()
    timed = pandas_sorted(vintage.attach_event_timing(vintage.attach_release_calendar(events(spark, STORY), cal), cal.drop("series_name")), "reference_date", "vintage_date")
    assert timed.event_reference_date[1] == day("2013-03-01") and timed.event_release_time.notna().all()


def test_canonical_rules(spark):
    with pytest.raises(checks.DataCheckError, match="initial_without_calendar"):
        vintage.attach_release_calendar(events(spark, STORY), calendar(spark, [("2013-02-01", "2013-03-07")]))
    late = calendar(spark, [("2013-02-01", "2013-03-08"), ("2013-03-01", "2013-04-11"), ("2013-04-01", "2013-05-09")])
    with pytest.raises(checks.DataCheckError, match="initial_before_release"):
        vintage.attach_release_calendar(events(spark, STORY), late)
    twice = calendar(spark, [("2013-02-01", "2013-03-07")] * 2)
    with pytest.raises(checks.DataCheckError, match="duplicate"):
        vintage.attach_release_calendar(events(spark, STORY), twice)


@pytest.mark.parametrize(
    "story, message",
    [
        ([("2013-02-01", "2013-01-01", 1.0)], "vintage_before_reference"),
        ([("2013-02-01", "2013-03-01", 1.0)] * 2, "duplicate_event"),
        ([], "empty"),
    ],
)
def test_broken_vintages_are_refused(spark, story, message):
    with pytest.raises(checks.DataCheckError, match=message):
        vintage.prepare_vintages(events(spark, story))
    with pytest.raises(checks.DataCheckError, match="missing required"):
        vintage.normalize_vintages(events(spark, STORY).drop("vintage_date"))


def test_unreadable_values_become_null(spark):
    raw = events(spark, STORY).withColumn("value_as_known", F.when(F.col("value_as_known") > 50400, ".").otherwise(F.col("value_as_known").cast("string")))
    got = vintage.prepare_vintages(raw)
    assert got.filter("value_as_known is null").count() == 3
    with pytest.raises(checks.DataCheckError, match="empty"):
        vintage.series_vintages(raw, "cpi")


def test_profile(spark):
    row = vintage.vintage_profile(events(spark, STORY)).first()
    assert (row.vintage_rows, row.reference_periods, row.revised_periods) == (6, 3, 2)
    assert (row.first_vintage, row.last_vintage) == (day("2013-03-07"), day("2013-05-09"))


# --------------------------------------------------------------- calendars


def plain_events(spark, **change):
    row = {"event_name": "employment_situation", "reference_date": day("2025-09-01"), "release_date": day("2025-11-20"),
           "release_time": "8:30", "release_timezone": "America/New_York", **change}
    return spark.createDataFrame([tuple(row.values())], "event_name string, reference_date date, release_date date, release_time string, release_timezone string")


def test_employment_calendars(spark):
    got = calendars.employment_calendars(plain_events(spark))
    assert got.count() == len(EMPLOYMENT_SERIES) + 3
    late = got.filter(F.col("release_date") == "2025-12-16").toPandas()
    assert set(late.series_name) == {"nonfarm_payrolls", "average_weekly_hours", "average_hourly_earnings"}
    assert (got.toPandas().release_time == "08:30").all()


def test_late_release_must_be_new(spark):
    with pytest.raises(checks.DataCheckError, match="duplicate"):
        calendars.employment_calendars(plain_events(spark, reference_date=day("2025-10-01"), release_date=day("2025-12-16")))


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"event_name": "cpi"}, "unexpected_name"),
        ({"release_time": "25:00"}, "invalid_time"),
        ({"release_time": None}, "missing_release_time"),
        ({"release_timezone": "Nowhere/City"}, "invalid_timezone"),
        ({"release_date": day("2025-08-01")}, "release_before_reference"),
    ],
)
def test_broken_calendars_are_refused(spark, change, rule):
    with pytest.raises(checks.DataCheckError, match=rule):
        calendars.employment_calendars(plain_events(spark, **change))


def test_series_calendar_refuses_market_series(spark):
    cal = calendar(spark, [("2013-02-01", "2013-03-07")])
    assert calendars.series_calendar(cal, PAY).count() == 1
    with pytest.raises(checks.DataCheckError, match="does not require"):
        calendars.series_calendar(cal, "breakeven_5y")
    with pytest.raises(checks.DataCheckError, match="empty"):
        calendars.series_calendar(cal, "cpi")
    with pytest.raises(ValueError, match="unknown"):
        calendars.series_calendar(cal, "moon_phase")


def test_release_attachment_and_audits(spark):
    obs = spark.createDataFrame([(PAY, day("2013-02-01"), 1.0), (PAY, day("2013-03-01"), 2.0), (PAY, day("2013-04-01"), None)], "series_name string, reference_date date, value double")
    cal = calendar(spark, [("2013-02-01", "2013-03-07")])
    with pytest.raises(checks.DataCheckError, match="without release"):
        calendars.attach_releases(obs, cal, enforce=True)
    aligned = calendars.attach_releases(obs, cal)
    row = checks.release_coverage(aligned).first()
    assert (row.non_null_observations, row.matched_release_events, row.unmatched_observations, row.coverage_rate) == (2, 1, 1, 0.5)
    audit = checks.availability_audit(calendars.release_sensitive(obs, cal)).first()
    assert (audit.observations, audit.valid_availability, audit.invalid_availability) == (2, 1, 1)
    own = calendars.market_observed(obs).toPandas()
    assert (own.market_date_available == own.reference_date).all()
    assert checks.reference_window(aligned, "2013-02-01", "2013-03-01").count() == 2


def test_release_instant_follows_daylight_saving(spark):
    rows = calendar(spark, [("2025-06-01", "2025-07-03"), ("2025-11-01", "2025-12-16")])
    got = rows.select(F.date_format(calendars.release_instant(), "HH:mm").alias("t"), "release_date").orderBy("release_date").collect()
    assert [r.t for r in got] == ["12:30", "13:30"]
