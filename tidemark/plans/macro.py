"""Queries over vintages, calendars, events and assessments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.catalog import EMPLOYMENT_SERIES, PAYROLL_FEATURES
from tidemark.functions.scalars import rounded
from tidemark.operators import asof, assessment, calendars, checks, folds, payroll, stats, vintage
from tidemark.plans import panels, views
from tidemark.sources import readers

EVENT = ["series_name", "reference_date", "vintage_date"]
AS_OF = "1998-06-15"


def _as_double(df, column):
    """Nullable counts compare as doubles, whatever the client makes of NULL integers."""
    return df.withColumn(column, F.col(column).cast("double"))


def s06_vintage_payload(spark, d):
    """Vintages folded into the wide JSON form of the data service, then parsed back."""
    cells = F.map_from_entries(
        F.collect_list(
            F.struct(
                F.concat("series_id", F.lit("_"), F.date_format("vintage_date", "yyyyMMdd")),
                F.coalesce(F.format_string("%.2f", "value_as_known"), F.lit(".")),
            )
        )
    )
    observation = F.map_concat(F.create_map(F.lit("date"), F.date_format("reference_date", "yyyy-MM-dd")), F.col("_cells"))
    payload = (
        views.vintages(spark, d)
        .groupBy("series_name", "series_id", "reference_date")
        .agg(cells.alias("_cells"))
        .select(
            "series_name",
            "series_id",
            F.to_json(F.struct(F.array(observation).alias("observations"))).alias("payload"),
        )
    )
    return rounded(readers.vintage_events(payload))


def s10_registry_stamp(spark, d):
    """Observations of five series stamped with the registry's metadata."""
    names = F.array(*[F.lit(s) for s in EMPLOYMENT_SERIES[:5]])
    slot = F.substring("series_name", 1, 1).cast("int")
    named = panels.observations(spark, d).withColumn("series_name", F.element_at(names, slot))
    return rounded(readers.stamp_registry(named, calendars.registry(spark)))


def s14_fingerprint(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def p17_vintages_prepared(spark, d):
    return rounded(vintage.prepare_vintages(views.vintages(spark, d)))


def v01_vintage_rule_counts(spark, d):
    dirty = views.vintages_dirty(spark, d)
    return checks.rule_counts(dirty, checks.vintage_rules(), ["series_name"])


def v04_vintage_order_violations(spark, d):
    return vintage.vintage_violations(views.vintages_dirty(spark, d))


def v05_duplicate_keys(spark, d):
    return checks.duplicate_keys(
        views.table(spark, d, "orders").select(
            F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("market_date")
        ),
        ["symbol", "market_date"],
    )


def v07_release_clock_checks(spark, d):
    """Clock and zone rules over calendar rows with some broken ones."""
    broken = views.release_calendar(spark, d).select(
        "series_name",
        "reference_date",
        "release_date",
        F.when(F.month("reference_date") == 3, "25:10").when(F.month("reference_date") == 4, "8:5").otherwise("08:30").alias("release_time"),
        F.when(F.month("reference_date") == 5, "Mars/Olympus").otherwise("America/New_York").alias("release_timezone"),
    )
    normal = calendars.normalize_calendar(broken)
    found = calendars.calendar_violations(normal, "series_name")
    return found.select("check", "series_name", "reference_date")


def v10_initial_calendar_check(spark, d):
    joined = vintage.with_history(views.vintages(spark, d)).join(
        panels.partial_calendar(spark, d).select("series_name", "reference_date", F.col("release_date").alias("original_release_date")),
        ["series_name", "reference_date"],
        "left",
    )
    return vintage.canonical_violations(joined)


def v13_availability_audit(spark, d):
    prepared = calendars.release_sensitive(panels.observations(spark, d), panels.partial_calendar(spark, d))
    return checks.availability_audit(prepared)


def v14_reference_window(spark, d):
    prepared = calendars.release_sensitive(panels.observations(spark, d), views.release_calendar(spark, d))
    return rounded(checks.reference_window(prepared, "1997-09-01", "1997-11-01"))


def v15_release_coverage(spark, d):
    aligned = calendars.attach_releases(panels.observations(spark, d), panels.partial_calendar(spark, d))
    return rounded(checks.release_coverage(aligned))


def s03_raw_observations(spark, d):
    """Raw observations by the checked scan: days and sums of what it reads."""
    rows = readers.read_observations(spark, f"{d}/orders.parquet", "o_orderdate", "o_totalprice", form="parquet")
    return rounded(
        rows.groupBy("reference_date").agg(F.count("value").alias("observations"), F.max("value").alias("greatest"))
    )


def v15_reconciled_copies(spark, d):
    """All line items against a copy with planted faults: lost, doubled, changed rows and changed NULLs."""
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    rows = views.table(spark, d, "lineitem").select(*columns)
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    copies = F.when((key % 97 == 0) | ((key % 89 == 0) & (line == 1)), 0).when((key % 83 == 0) & (line == 2), 2).otherwise(1)
    faulty = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).filter(F.col("_copy") <= copies).drop("_copy")
    faulty = faulty.withColumn("l_quantity", F.when(key % 79 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    faulty = faulty.withColumn("l_returnflag", F.when(key % 73 != 0, F.col("l_returnflag")))
    known = rows.withColumn("l_returnflag", F.when(key % 71 != 0, F.when(key % 73 != 0, F.col("l_returnflag"))))
    return checks.reconcile(known, faulty, ["l_orderkey"])


def v15_coverage_disagreements(spark, d):
    """The release coverage against problem rows of which one series' are planted as lost."""
    aligned = calendars.attach_releases(panels.observations(spark, d), panels.partial_calendar(spark, d))
    kept = checks.coverage_problems(aligned).filter(~F.col("series_name").startswith("1"))
    return checks.coverage_disagreements(checks.release_coverage(aligned), kept)


def v11_coverage_problems(spark, d):
    aligned = calendars.attach_releases(panels.observations(spark, d), panels.partial_calendar(spark, d))
    return rounded(checks.coverage_problems(aligned).select("series_name", "reference_date", "value"))


def w19_initial_release(spark, d):
    out = vintage.with_history(views.vintages(spark, d))
    return rounded(
        out.select(*EVENT, "value_as_known", "previous_value", "known_until", F.col("is_initial_release").cast("int").alias("is_initial_release"))
    )


def w20_reconstruct_as_of(spark, d):
    return rounded(vintage.reconstruct_as_of(views.vintages(spark, d), AS_OF))


def w21_latest_period(spark, d):
    return rounded(vintage.latest_period_as_of(views.vintages(spark, d), AS_OF))


def _event_dates(spark, d):
    return views.event_calendar(spark, d).select("series_name", F.col("release_date").alias("event_date"))


def j13_states_as_of_events(spark, d):
    dates = _event_dates(spark, d).withColumnRenamed("event_date", "as_of_date")
    states = vintage.states_as_of(views.vintages(spark, d), dates)
    return rounded(
        states.groupBy("series_name", "as_of_date").agg(
            F.count(F.lit(1)).alias("periods"),
            F.max("reference_date").alias("newest"),
            F.sum("value_as_known").alias("total"),
        ),
        2,
    )


def w22_state_changes(spark, d):
    dates = _event_dates(spark, d).withColumnRenamed("event_date", "as_of_date")
    states = vintage.with_period_change(vintage.states_as_of(views.vintages(spark, d), dates))
    return rounded(
        states.select(
            "series_name", "as_of_date", "reference_date", "payroll_level", "payroll_change_1m"
        ),
        2,
    )


def j06_release_calendar_attach(spark, d):
    out = panels.canonical(spark, d)
    return rounded(out.withColumn("is_initial_release", F.col("is_initial_release").cast("int")))


def j07_event_timing(spark, d):
    events = views.event_calendar(spark, d).filter(F.month("release_date") != 12)
    out = vintage.attach_event_timing(panels.canonical(spark, d), events, ("series_name",), enforce=False)
    return rounded(out.select(*EVENT, "value_as_known", "event_name", "event_reference_date", "event_release_date", "event_release_time"))


def w23_event_revisions(spark, d):
    return rounded(payroll.event_revisions(views.vintages(spark, d)), 2)


def a16_revision_breadth(spark, d):
    return payroll.event_breadth(views.vintages(spark, d))


def a15_first_vintage(spark, d):
    return views.vintages(spark, d).groupBy("series_name", "reference_date").agg(F.min("vintage_date").alias("first_vintage_date"))


def a17_vintage_profile(spark, d):
    return vintage.vintage_profile(views.vintages(spark, d))


def w24_event_features(spark, d):
    return rounded(payroll.event_features(views.vintages(spark, d), _event_dates(spark, d)), 2)


def w25_event_history(spark, d):
    return rounded(panels.event_history(spark, d).drop("event_release_time", "event_release_timezone"), 4)


def w26_prior_zscore(spark, d):
    return rounded(
        panels.event_history(spark, d).select("series_name", "event_release_date", "payroll_change_1m", "payroll_change_z"), 4
    )


def w27_regular_revision_zscore(spark, d):
    """Broadness above eight periods, so that both kinds of event occur."""
    events = panels.event_history(spark, d).drop("payroll_change_z", "payroll_revision_z").withColumn(
        "payroll_broad_revision_event", (F.col("payroll_revised_periods") % 3 == 0).cast("int")
    )
    out = payroll.with_zscores(events, 12)
    return rounded(out.select("series_name", "event_release_date", "payroll_broad_revision_event", "payroll_revision_total", "payroll_revision_z"), 4)


def j04_events_to_market(spark, d):
    columns = [
        "symbol", "market_date", "event_release_date", "reference_date", "payroll_level", "payroll_revision_total",
        "days_since_payroll_release", "payroll_release_day",
    ]
    out = panels.event_market(spark, d).select(*columns)
    return rounded(_as_double(out, "days_since_payroll_release"), 2)


def _prepared(spark, d):
    return calendars.release_sensitive(panels.observations(spark, d), views.release_calendar(spark, d))


def j02_macro_series_asof(spark, d):
    bars = views.bars_daily(spark, d).select("symbol", "market_date", "close")
    one = _prepared(spark, d).filter(F.col("series_name") == panels.EVENT_SERIES)
    return rounded(_as_double(asof.attach_macro_series(bars, one, "urgent"), "urgent_data_age_days"))


def j03_macro_family_asof(spark, d):
    bars = views.bars_daily(spark, d).select("symbol", "market_date", "close")
    out = asof.attach_macro_family(bars, _prepared(spark, d), panels.MACRO_SERIES)
    names = dict(zip(panels.MACRO_SERIES, ("urgent", "high", "medium", "unspecified", "low")))
    picked = []
    for series, short in names.items():
        picked += [
            F.col(f"`{series}`").alias(short),
            F.col(f"`{series}_reference_date`").alias(f"{short}_reference_date"),
            F.col(f"`{series}_data_age_days`").cast("double").alias(f"{short}_data_age_days"),
        ]
    return rounded(out.select("symbol", "market_date", *picked))


def j05_observation_releases(spark, d):
    return rounded(calendars.attach_releases(panels.observations(spark, d), panels.partial_calendar(spark, d)))


def p12_market_observed(spark, d):
    return rounded(calendars.market_observed(panels.observations(spark, d)))


def p15_informative_observations(spark, d):
    return rounded(asof.macro_columns("macro", panels.observations(spark, d)))


def _events_by_report(spark, d):
    return views.event_calendar(spark, d).withColumnRenamed("series_name", "report")


def j11_calendar_expansion(spark, d):
    return calendars.expand_event_calendar(_events_by_report(spark, d), EMPLOYMENT_SERIES, ["report"])


def u02_late_release(spark, d):
    full = calendars.expand_event_calendar(_events_by_report(spark, d), EMPLOYMENT_SERIES, ["report"])
    return calendars.add_late_release(full, by=["report"])


def release_instants(spark, d):
    """Local release clocks as UTC instants (summer and winter time)."""
    rows = views.release_calendar(spark, d)
    utc = calendars.release_instant()
    return rows.select("series_name", "reference_date", F.date_format(utc, "yyyy-MM-dd HH:mm").alias("released_utc"))


RELEASE_FEATURES = PAYROLL_FEATURES[:-1]


def a09_daily_event_correlations(spark, d):
    return rounded(stats.event_correlations(panels.event_development(spark, d), PAYROLL_FEATURES, "forward_return_5"))


def p06_release_day_correlations(spark, d):
    rows = panels.event_development(spark, d).filter("payroll_release_day = 1")
    return rounded(stats.event_correlations(rows, RELEASE_FEATURES, "forward_return_5"))


def a10_release_correlation_matrix(spark, d):
    rows = panels.event_development(spark, d).filter("payroll_release_day = 1")
    return rounded(stats.correlation_matrix(rows, ["payroll_change_1m", "payroll_revision_total", "forward_return_5"]))


def a11_event_distribution(spark, d):
    return rounded(stats.describe_columns(panels.event_development(spark, d), PAYROLL_FEATURES), 4)


def a23_revision_sign_means(spark, d):
    rows = panels.event_development(spark, d).filter("payroll_release_day = 1")
    centred = rows.withColumn("payroll_revision_total", F.col("payroll_revision_total") - F.lit(1000000.0))
    return rounded(stats.sign_conditional_means(centred, "payroll_revision_total", "forward_return_5"))


def f04_event_development(spark, d):
    return panels.event_development(spark, d).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max("market_date").alias("last_date"), F.max("target_end_date").alias("last_target")
    )


def t04_largest_revisions(spark, d):
    rows = panels.event_development(spark, d).filter("payroll_release_day = 1")
    columns = ["market_date", "symbol", "payroll_revision_1m", "payroll_revision_2m", "payroll_revision_total"]
    return rounded(payroll.largest_revisions(rows, columns), 2)


def _forecasts(spark, d):
    """One recorded forecast per symbol and trading day."""
    rows = folds.with_target_end(views.bars_daily(spark, d), 5).filter(F.col("target_end_date").isNotNull())
    return rows.select(
        "symbol",
        F.lit("final_model").alias("model"),
        F.col("market_date").alias("forecast_origin"),
        F.col("target_end_date").alias("forecast_target_date"),
        F.lit(5).alias("horizon_trading_days"),
        (F.pmod(F.col("close"), F.lit(125.0)) / 100).alias("probability_positive_return"),
    )


def s11_forecast_contract(spark, d):
    return assessment.forecast_violations(_forecasts(spark, d), "final_model", by=["symbol"])


def _daily_report(spark, d, ahead):
    """Orders as report rows: those of the symbol ``ahead`` places further on report on a symbol.

    Several per day make the day ambiguous.
    """
    names = panels.MACRO_SERIES
    symbol = F.coalesce(
        *[F.when(F.col("o_orderpriority") == names[(i + ahead) % len(names)], F.lit(name)) for i, name in enumerate(names)]
    )
    return views.table(spark, d, "orders").select(
        symbol.alias("symbol"), F.to_date("o_orderdate").alias("market_date"), F.col("o_orderstatus").alias("state")
    )


def v18_report_status(spark, d):
    return assessment.report_status(_forecasts(spark, d), _daily_report(spark, d, 1), by=["symbol"]).select(
        "symbol", "as_of", "status", "latest_available_as_of", F.get_json_object("data", "$.state").alias("state")
    )


def j12_assessments(spark, d):
    reports = {"opportunity": _daily_report(spark, d, 1), "risk": _daily_report(spark, d, 2)}
    out = assessment.assess(_forecasts(spark, d), reports, by=["symbol"])
    return out.select(
        "symbol",
        "forecast_origin",
        F.col("opportunity.status").alias("opportunity_status"),
        F.col("risk.status").alias("risk_status"),
        F.col("all_assessments_date_aligned").cast("int").alias("aligned"),
        F.col("trading.status").alias("trading_status"),
    )


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")
}
