"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and parallelism. Every query is written in full to a no-op sink, so no
column is pruned and nothing is collected. The shared panels are derived inside
the first query that needs them and count towards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import registry  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "w00_bars_daily",
    "technical_features_all",
    "w11_directional_score",
    "a01_score_summary",
    "w14_signal_ledger",
    "w18_curve_factors",
    "m01b_nelson_siegel_dynamics",
    "j01_curve_asof_bars",
    "a02_regime_summary",
    "m02_hac_inference",
    "a08_technical_relationships",
    "p17_vintages_prepared",
    "j13_states_as_of_events",
    "w25_event_history",
    "j03_macro_family_asof",
    "j04_events_to_market",
    "a12_quintile_summary",
    "a22_classification_metrics",
    "m04_ridge_walk_forward",
    "m07_logistic_walk_forward",
    "j01_curve_asof_bars_keyed",
    "e01_five_minute_bars",
    "e04_session_vwap",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidemark-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.ALL[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
