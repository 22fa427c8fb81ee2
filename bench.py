"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eligra.plans import all_queries  # noqa: E402
from eligra.session import local_session  # noqa: E402

HEADLINE = (
    "cohort_select", "dx_clean_crosswalk", "rx_clean", "lab_zscore", "lab_daily_grid", "patient_state",
    "match_rule_label", "match_rule_engine", "match_strict", "eligibility_label", "label_stats", "topk_patients_per_trial",
    "coverage_rollup", "resolution_pivot", "comorbidity_edges", "dx_rx_bridge", "neighbor_mean", "visit_sequences",
    "roc_auc_pooled", "roc_auc_per_trial", "topk_metrics", "brier_ece", "split_quadrants", "bootstrap_ci",
    "criteria_sections", "numeric_bounds", "parse_terms", "tfidf",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    found, times = all_queries(), {}
    for name in HEADLINE:
        start = time.time()
        found[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
