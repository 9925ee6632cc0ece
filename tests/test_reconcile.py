"""Two sides prove each other; raw scans refuse missing columns."""

import pytest

from tidemark.operators import checks
from tidemark.sources import readers

SCHEMA = "k string, a int, b string"
ROWS = [("x", 1, None), ("x", 2, "u"), ("x", 2, "u"), ("y", None, "w"), (None, 5, "z"), ("q", 7, "q")]


def _differences(spark, right):
    left = spark.createDataFrame(ROWS, SCHEMA)
    found = checks.reconcile(left.repartition(5), spark.createDataFrame(right, SCHEMA).repartition(3), ["k"])
    return {r.k: (r.left_rows, r.right_rows, r.difference) for r in found.collect()}


def test_equal_multisets_in_any_order_give_no_row(spark):
    assert _differences(spark, ROWS[::-1]) == {}
    assert _differences(spark, []) == {
        "x": (3, 0, "missing_right"), "y": (1, 0, "missing_right"), None: (1, 0, "missing_right"), "q": (1, 0, "missing_right")
    }


def test_each_planted_fault_is_named(spark):
    right = [
        ("x", 1, None), ("x", 1, None), ("x", 2, "u"),  # another row is the one repeated
        ("y", None, "w"), ("y", None, "w"),  # doubled
        (None, 6, "z"),  # changed below a NULL key
        ("new", 1, "n"),
    ]
    assert _differences(spark, right) == {
        "x": (3, 3, "values"), "y": (1, 2, "row_count"), None: (1, 1, "values"), "new": (0, 1, "missing_left"), "q": (1, 0, "missing_right")
    }


def test_null_moved_to_another_column_is_a_change(spark):
    one = spark.createDataFrame([("k", "v", None)], "k string, a string, b string")
    other = spark.createDataFrame([("k", None, "v")], "k string, a string, b string")
    assert checks.reconcile(one, other, ["k"]).first().difference == "values"


def test_other_columns_are_an_error(spark):
    left = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(checks.DataCheckError):
        checks.reconcile(left, left.drop("b"), ["k"])
    with pytest.raises(checks.DataCheckError):
        checks.reconcile(left.drop("b"), left, ["k"])


def test_coverage_agrees_with_its_detail_or_says_so(spark):
    aligned = spark.createDataFrame(
        [("s", 1.0, "2020-01-01"), ("s", 2.0, None), ("t", 3.0, None), ("u", None, None), (None, 4.0, None)],
        "series_name string, value double, release_date string",
    )
    summary, detail = checks.release_coverage(aligned), checks.coverage_problems(aligned)
    assert checks.coverage_disagreements(summary, detail).count() == 0
    lost = checks.coverage_disagreements(summary, detail.filter("series_name = 's'")).collect()
    assert {(r.series_name, r.unmatched_observations, r.detail_rows) for r in lost} == {("t", 1, 0), (None, 1, 0)}
    alone = checks.coverage_disagreements(summary.filter("series_name = 's'"), detail).collect()
    assert {(r.series_name, r.detail_rows) for r in alone} == {("t", 1), (None, 1)}


def test_raw_scan_refuses_a_missing_column(spark, tmp_path):
    (tmp_path / "good.csv").write_text("day,level\n2021-03-04,1.5\n2021-03-05,n/a\n")
    (tmp_path / "bad.csv").write_text("day,other\n2021-03-04,1.5\n")
    got = readers.read_observations(spark, str(tmp_path / "good.csv"), "day", "level").orderBy("reference_date").collect()
    assert [r.value for r in got] == [1.5, None]
    with pytest.raises(checks.DataCheckError, match="level"):
        readers.read_observations(spark, str(tmp_path / "bad.csv"), "day", "level")
