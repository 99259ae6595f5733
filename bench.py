"""Headline queries on one machine: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_SECONDS (default 1700): beyond them, or on SIGTERM, the line has the queries done so far.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from landgrid.plans.registry import QUERIES
from landgrid.session import local_session

HEADLINE = (
    "feature_stack", "minmax_normalize", "best_scene", "transition_pairs", "change_ref",
    "ring_zone_touch", "shannon_entropy", "ueii", "directional_growth", "class_area", "area_stats",
    "confusion_matrix", "accuracy_report", "focal_majority", "aggregate_modal", "resample_bilinear",
    "slope_deg", "distance_transform", "rasterize_lines", "connected_components", "sieve_small",
    "landscape_metrics", "patch_label", "sliding_window_mean", "stratified_points",
    "train_test_split", "driver_stack", "knn_weights", "morans_i", "predict_pixels",
)


class Stopped(Exception):
    pass


def stop(*_) -> None:
    raise Stopped


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "landgrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    signal.signal(signal.SIGTERM, stop)
    signal.signal(signal.SIGALRM, stop)
    signal.alarm(int(os.environ.get("BENCH_SECONDS", "1700")))
    try:
        sink(QUERIES["class_area"](spark, sf_dir))
        for name in HEADLINE:
            start = time.perf_counter()
            try:
                sink(QUERIES[name](spark, sf_dir))
            except Stopped:
                raise
            except Exception as e:  # the other times are worth having
                failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
                continue
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    except Stopped:
        failed["stopped"] = f"after {len(times)} of {len(HEADLINE)} queries"
    signal.alarm(0)
    line = {"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
            "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line | ({"failed": failed} if failed else {})), flush=True)
    if "stopped" not in failed:
        spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
