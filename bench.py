"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the ``noop`` sink (no driver collect) and
timed once after one warm-up query; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil.plans import load_all  # noqa: E402
from vigil.session import local_session, ship_package  # noqa: E402

HEADLINE = [
    "w16_all_features",
    "w1_w5_rolling_lineitem",
    "w6_w8_change_gaps",
    "c3_c4_fill_chain",
    "c10_clean",
    "g4_label_correlation",
    "a1_a2_build_alerts",
    "d5_equipment_status",
    "w17_latest_features",
    "m10_train_metrics",
    "m12_score_all",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="vigil-bench")
    reg = load_all()
    ship_package(spark)
    # warm-up: the same code paths on the smallest scale (JIT, codegen caches)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.exists(os.path.join(small, "events.parquet")) else sf_dir
    for n in ("w16_all_features", "w1_w5_rolling_lineitem"):
        reg[n].spark(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
