"""Time the headline queries and print one JSON line.

Each query runs once, in order, into the no-op sink, so every row and column
is computed. Queries that share stored stages pay for them in `dataset_build`
and `simulation_stages`.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_stays", "row_number", "flag_admitted", "complete_admissions", "pair_admissions",
    "inpatient_day_table", "baseline_distribution", "previous_event", "known_before",
    "code_counts", "rank_nonnumeric_tokens", "numeric_stats", "percentile_grid", "nearest_bin",
    "dedup_lab_reports", "interval_cohort", "first_event_after", "visit_span", "temporal_split",
    "cohort_stats", "code_prevalence", "bootstrap_cohort_stats", "lab_pivot", "correlation_matrix",
    "explode_rows", "label_timeline", "event_view", "timeline_matrix", "training_windows",
    "time_shuffle", "window_to_events", "last_observation", "mc_event_probability",
    "length_calibration", "patient_code_matrix", "sex_plausibility_summary",
    "confusion_by_threshold", "auroc", "auprc", "calibration_bins", "lowess_curve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from chronoline import build_session
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from checks import q_timeline, registry, views
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        run()
        took[name] = round(time.time() - start, 3)

    if not sys.argv[1:]:
        timed("dataset_build", lambda: q_timeline.build(spark, sf_dir).labelled())
        timed("simulation_stages", lambda: (views.windows(spark, sf_dir), views.simulated(spark, sf_dir)))
    for name in names:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
