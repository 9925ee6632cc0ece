"""The registered queries against their SQL at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, canonical  # noqa: E402

from tidemark.plans import registry  # noqa: E402
from tidemark.plans.oracle import ORACLE  # noqa: E402

SOME = [
    "w05_ema_distances", "w14_signal_ledger", "a01_score_summary", "p02_complete_curves", "j01_curve_asof_bars", "m02_hac_inference",
    "w22_state_changes", "j12_assessments", "u02_late_release", "m04_single_ridge_walk_forward", "m04_ridge_walk_forward", "m07_logistic_walk_forward", "e12_variance_inflation",
    "w25_event_history", "j03_macro_family_asof", "v07_release_clock_checks", "a22_classification_metrics", "v18_report_status", "e08_event_distance",
]
NAMES = sorted(ORACLE) if os.environ.get("TIDEMARK_ALL") else SOME


@pytest.fixture(scope="module")
def oracle(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.ALL) == set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, oracle, name):
    got = entry.queries()[name](spark, folder).toPandas()
    want = oracle.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
