"""Readers, sinks, forecasts and reports on real files."""

import hashlib
import json

import pyarrow.parquet as pq
import pytest
from helpers import day, pandas_sorted

from tidemark.operators import assessment, calendars, checks
from tidemark.sources import readers, sinks


def test_bars_from_csv(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text(" Date ,Open,High,Low,Close,Volume\n2026-01-05,1,2,0.5,1.5,100\n2026-01-02,1,2,0.5,1.4,90\n2026-01-02,9,9,9,9,9\n")
    got = pandas_sorted(readers.read_bars_csv(spark, str(path), "ETF"), "market_date")
    assert got.close.tolist() == [1.4, 1.5] and got.symbol.tolist() == ["ETF", "ETF"]
    assert got.market_date.tolist() == [day("2026-01-02"), day("2026-01-05")]


@pytest.mark.parametrize("text, message", [("Open,High,Low,Close,Volume\n1,1,1,1,1\n", "time column"), ("Date,Open\n2026-01-02,1\n", "missing required")])
def test_bad_bar_files(spark, tmp_path, text, message):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises(checks.DataCheckError, match=message):
        readers.read_bars_csv(spark, str(path))


def test_non_numeric_price_fails(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Date,Open,High,Low,Close,Volume\n2026-01-02,1,2,x,1.4,90\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_bars_csv(spark, str(path)).collect()


def test_download_normaliser(spark):
    raw = spark.createDataFrame([("2026-01-02", 1.0, 1.0, 1.0, 1.0, 5, "x")], "`Date` string, Open double, High double, Low double, Close double, Volume long, `Stock Splits` string")
    assert readers.normalize_download(raw).columns == ["timestamp", "open", "high", "low", "close", "volume"]
    with pytest.raises(checks.DataCheckError, match="empty"):
        readers.normalize_download(raw.limit(0))


PAYLOAD = {"observations": [
    {"date": "2013-02-01", "PAYEMS_20130309": "612.5", "PAYEMS_20130413": "614", "OTHER_20130413": "9"},
    {"date": "2013-03-01", "PAYEMS_20130413": "."},
]}


def payload(spark, body):
    return spark.createDataFrame([("nonfarm_payrolls", "PAYEMS", json.dumps(body))], "series_name string, series_id string, payload string")


def test_vintage_payload(spark):
    got = pandas_sorted(readers.vintage_events(payload(spark, PAYLOAD)), "reference_date", "vintage_date")
    assert got.vintage_date.tolist() == [day("2013-03-09"), day("2013-04-13"), day("2013-04-13")]
    assert got.value_as_known.fillna(-1).tolist() == [612.5, 614, -1]


@pytest.mark.parametrize("body", [{"observations": [{"date": "2013-02-01", "PAYEMS_2013XX09": "1"}]}, {"observations": [{"PAYEMS_20130309": "1"}]}])
def test_broken_payloads_fail(spark, body):
    with pytest.raises(Exception):
        readers.vintage_events(payload(spark, body)).collect()


def test_registry_stamp_and_series_sink(spark, tmp_path):
    obs = spark.createDataFrame([("cpi", day("2025-01-01"), 300.0), ("unlisted", day("2025-01-01"), 1.0)], "series_name string, reference_date date, value double")
    with pytest.raises(checks.DataCheckError, match="unlisted"):
        readers.stamp_registry(obs, calendars.registry(spark))
    stamped = readers.stamp_registry(obs.filter("series_name = 'cpi'"), calendars.registry(spark))
    assert stamped.columns == ["reference_date", "value", "series_name", "series_id", "category", "source", "frequency", "units"]
    sinks.write_series_table(stamped, str(tmp_path / "obs"))
    assert (tmp_path / "obs" / "series_name=cpi").is_dir()
    back = readers.read_table(spark, str(tmp_path / "obs"), form="parquet")
    assert back.first().series_id == "CPIAUCSL"


def test_report_sinks(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.write_report(one, str(tmp_path / "r"))
    assert readers.read_table(spark, str(tmp_path / "r"), "n int, s string").first().s == "a"
    sinks.write_json_once(one, str(tmp_path / "j"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_json_once(one, str(tmp_path / "j"))


FORECAST = {"model": "final_model", "forecast_origin": "2026-07-10", "forecast_target_date": "2026-07-17", "issued_at_utc": "2026-07-10T21:00:00Z",
            "horizon_trading_days": 5, "probability_positive_return": 0.55, "tmf_close": 33.0, "training_base_rate": 0.5}


def test_forecast_scan_and_latest_file(spark, tmp_path):
    for stamp, p in (("20260709", 0.4), ("20260710", 0.55)):
        (tmp_path / f"F_{stamp}.json").write_text(json.dumps({**FORECAST, "probability_positive_return": p}))
    (tmp_path / "notes.txt").write_text("x")
    newest = readers.latest_file(spark, str(tmp_path), "F_*.json")
    assert newest.endswith("F_20260710.json")
    got = readers.read_forecasts(spark, newest)
    assert assessment.forecast_violations(got, "final_model", "issued_text").isEmpty()
    assert got.first().probability_positive_return == 0.55
    sha = readers.fingerprints(spark, newest).first().sha256
    assert sha == hashlib.sha256((tmp_path / "F_20260710.json").read_bytes()).hexdigest()
    assert got.first().source_sha256 == sha
    with pytest.raises(checks.DataCheckError):
        readers.latest_file(spark, str(tmp_path), "none*.json")


def test_each_forecast_carries_the_hash_of_its_own_file(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    for n in (5, 10):
        (folder / f"f{n}.json").write_text(json.dumps({**FORECAST, "horizon_trading_days": n}))
    got = {r.horizon_trading_days: r.source_sha256 for r in readers.read_forecasts(spark, str(folder)).collect()}
    assert got == {n: hashlib.sha256((folder / f"f{n}.json").read_bytes()).hexdigest() for n in (5, 10)}


def test_ordered_sink_keeps_the_key_order_over_sixteen_files(spark, tmp_path):
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = spark.range(2000).selectExpr("if(id % 50 = 0, null, concat('s', pmod(hash(id), 7))) as symbol", "pmod(hash(id, 1), 500) as n", "id")
        sinks.write_ordered(rows.repartition(5), str(tmp_path / "o"), ["symbol", "n", "id"])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    files = sorted((tmp_path / "o").glob("*.parquet"))
    back = [(r["symbol"] is not None, r["symbol"] or "", r["n"], r["id"]) for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) == 16 and len(back) == 2000 and back == sorted(back)


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"model": "other"}, "model"), ({"horizon_trading_days": 10}, "horizon"), ({"forecast_target_date": "2026-07-10"}, "target_after_origin"),
        ({"probability_positive_return": 1.5}, "probability"), ({"probability_positive_return": None}, "probability"),
        ({"issued_at_utc": "2026-07-10T21:00:00"}, "issue_time_zone"),
    ],
)
def test_forecast_contract(spark, tmp_path, change, rule):
    (tmp_path / "f.json").write_text(json.dumps({**FORECAST, **change}))
    found = assessment.forecast_violations(readers.read_forecasts(spark, str(tmp_path / "f.json")), "final_model", "issued_text")
    assert [r.check for r in found.collect()] == [rule]


def report(spark, *rows):
    return spark.createDataFrame([(day(d) if d else None, s) for d, s in rows], "market_date date, state string")


@pytest.mark.parametrize(
    "rows, status, latest",
    [
        ([("2026-07-09", "old"), ("2026-07-10", "now"), ("2026-07-13", "next")], "matched", None),
        ([("2026-07-08", "old"), ("2026-07-09", "old"), ("2026-07-13", "next")], "date_mismatch", "2026-07-09"),
        ([("2026-07-13", "next")], "date_mismatch", None),
        ([("2026-07-10", "a"), ("2026-07-10", "b")], "ambiguous_duplicate_date", None),
        ([], "empty", None),
        ([(None, "a"), ("2026-07-10", "b")], "invalid_schema", None),
    ],
)
def test_report_status_never_substitutes(spark, rows, status, latest):
    origin = spark.createDataFrame([(day("2026-07-10"),)], "forecast_origin date")
    row = assessment.report_status(origin, report(spark, *rows)).first()
    assert row.status == status and row.latest_available_as_of == (day(latest) if latest else None)
    assert (json.loads(row.data)["state"] == "now") if status == "matched" else row.data is None


def test_missing_report(spark):
    origin = spark.createDataFrame([(day("2026-07-10"),)], "forecast_origin date")
    assert assessment.report_status(origin, report(spark), available=False).first().status == "unavailable"
    assert assessment.report_status(origin, report(spark), schema_ok=False).first().status == "invalid_schema"


def test_assessment_flag(spark):
    forecast = spark.createDataFrame([(day("2026-07-10"), 0.5)], "forecast_origin date, p double")
    good, stale = report(spark, ("2026-07-10", "x")), report(spark, ("2026-07-09", "x"))
    assert assessment.assess(forecast, {"a": good, "b": good}).first().all_assessments_date_aligned
    row = assessment.assess(forecast, {"a": good, "b": stale}).first()
    assert not row.all_assessments_date_aligned and row.trading.status == "NOT_AUTHORIZED_READ_ONLY"
    assert not row.trading.orders_generated


def test_report_date_columns(spark):
    stamps = spark.createDataFrame([("2026-07-11T01:30:00Z",), ("2026-07-10T10:00:00",)], "timestamp string")
    got = [r.market_date for r in readers.report_dates(stamps).collect()]
    assert got == [day("2026-07-10"), None]
    plain = spark.createDataFrame([("2026-07-10 extra", "2020-01-01")], "session_date string, timestamp string")
    assert readers.report_dates(plain).first().market_date == day("2026-07-10")
    with pytest.raises(checks.DataCheckError):
        readers.report_dates(spark.createDataFrame([(1,)], "x int"))


def test_observation_normaliser(spark):
    raw = spark.createDataFrame([("2025-01-01", "1.5"), ("2025-02-01", "."), ("2025-03-01", "NaN")], "DATE string, CPI string")
    got = pandas_sorted(readers.normalize_observations(raw, "DATE", "CPI"), "reference_date")
    assert got.value.isna().tolist() == [False, True, True]
