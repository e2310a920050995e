"""Time the headline queries end to end from the base tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from riskpanel.plans import change_queries as CQ
from riskpanel.plans.catalog import ALL
from riskpanel.session import forget_shared_tables, local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = {
    "trajectory_segments": ALL["trajectory_segments"].build,
    "adjacency_rules": ALL["adjacency_rules"].build,
    "fixed_lattice": ALL["fixed_lattice"].build,
    "state_features": ALL["state_features"].build,
    "transitions": ALL["transitions"].build,
    "landmark_summary": ALL["landmark_summary"].build,
    "support_screen": ALL["support_screen"].build,
    "fitted_process": ALL["fitted_process"].build,
    "change_scan": ALL["change_scan"].build,
    "m0_draws_999": lambda s, d: CQ.shift_draws(s, d, "M0", draws=999),
    "m3_draws": ALL["m3_draws"].build,
    "joint_exceedance": ALL["joint_exceedance"].build,
    "calibration_summary": ALL["calibration_summary"].build,
}


def run() -> dict[str, float]:
    spark = local_session(CPUS, partitions=int(CPUS))
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):  # start the JVM's compiled paths on the smallest tables before timing
        ALL["transitions"].build(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name, build in HEADLINE.items():
        forget_shared_tables()
        CQ.forget()
        start = time.perf_counter()
        build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    return times


if __name__ == "__main__":
    result = run()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(result.values()), 3), "unit": "sec",
                      "queries": result, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
