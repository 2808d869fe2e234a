"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and once for the time, into a sink that drops the rows, so that the numbers
measure the plan and not the transfer to Python. BENCH_QUERIES limits the run to some name prefixes.
"""

from __future__ import annotations

import json
import os
import sys
import time

from foldmark import plans
from foldmark.session import get_spark, scratch

HEADLINE = [
    "ENTRY_holdout_auc_report",
    "SPL1_holdout",
    "SPL2_stratified_holdout",
    "SPL5_stratified_kfold",
    "SPL8_time_expanding",
    "SPL14_multi_table",
    "NUL2_median_fill",
    "MTH2_ratios",
    "STR4_text_statistics",
    "AGG3_frequency_encode",
    "AGG4_describe",
    "WIN1_running_sum",
    "WIN2_lags",
    "MET2_roc_auc_pooled",
    "MET4_f1_macro",
    "MET9_rmse",
    "MET15_map_at_k",
    "MET16_map_full_list",
    "MET23_best_threshold",
    "ENC1_label_encode",
    "TXT4_tfidf",
    "MDL6_oof_target_mean",
    "LB9_aup_invln",
    "LB11_average_row",
    "LK2_leakage_counts",
    "LK5_enclosing_functions",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    with scratch():
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - started
    spark.catalog.clearCache()
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    plans.load_all()
    names = HEADLINE
    if wanted:
        names = [q for q in plans.QUERIES if any(q.startswith(w) for w in wanted.split(","))]
    spark = get_spark(cpus, "foldmark-bench", **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    times: dict[str, float] = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
