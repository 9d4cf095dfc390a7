"""Benchmark: headline catalogue queries plus the reference forest fit.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line. Each query is executed in full with the ``noop``
sink (every row produced, nothing collected to the driver). ``forest_fit`` is
the fit alone of the reference configuration (200 trees, depth 12, leaf >= 30,
sqrt features, balanced weights) on the 80 % training part, the quantity the
reference reports.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "zone_counts", "sites_clean", "features_all", "batch_scores", "single_scores", "condition_pass_rate",
    "district_rollup", "similar_districts", "similar_many_targets", "quality_report", "correlation",
    "histograms", "sample_scatter", "binary_metrics", "roc_auc", "calibration",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from sitescope.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    from sitescope.plans import catalog
    from sitescope.plans import model as M

    # warm the JVM once (class loading, codegen caches) outside the timings
    catalog.QUERIES["zone_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    result = M.train_model(catalog.sites(spark, sf_dir), "site_id", M.ForestConfig(),
                           cv_folds=0, partitions=int(cpus))
    times["forest_train_and_evaluate"] = round(time.perf_counter() - t0, 3)
    times["forest_fit"] = float(result.metrics["train_time_s"])
    total = round(sum(v for k, v in times.items() if k != "forest_fit"), 3)
    m = result.metrics
    print(json.dumps({
        "metric": "total_wall_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "forest": {k: m[k] for k in ("n_train", "n_test", "accuracy", "f1", "roc_auc", "overfit_gap", "train_time_s")},
        "baseline_forest_fit_s": 15.66,
    }))


if __name__ == "__main__":
    main()
