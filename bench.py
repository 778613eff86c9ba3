"""Time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "features_efficient", "features_comprehensive", "features_all_ragged", "multivariate_features", "var_correlation", "sliding_windows", "walk_forward_expanding", "stratified_split", "batches",
    "classification_report", "auc_ovr", "ece_mce", "optimal_temperature", "curriculum_weights", "difficulty_scores", "standardize_sample", "savitzky_golay", "time_warp", "mixup", "gasf", "recurrence_plot", "minirocket", "rocket_classifier",
]


def main() -> None:
    from panelwright.plans.registry import queries
    from panelwright.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("features_minimal")  # compiles and warms up
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
