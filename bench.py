"""Time the headline queries: one JSON line on stdout.

Every query runs twice and the second run counts; ``first_run`` lists the first ones, which
also pay for class loading and code generation.  BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetgauge.plans import load_all  # noqa: E402
from fleetgauge.session import build_session  # noqa: E402

HEADLINE = [
    "A01_suite_statistics", "A06_energy_trapezoid", "A17_telemetry_summary", "A21_implementation_statistics",
    "A22_campaign_summary", "A23_stability", "A26_tensor_compare", "A33_set_digest", "A36_copy_statistics", "A37_interval_coverage",
    "A38_trace_findings", "A45_media_validation", "A49_inference_parity", "J03_align_sequence", "J06_interval_overlap",
    "J12_fastest_other", "J25_evidence_set_errors", "P04_extract_identity", "P11_report_identity_check",
    "P16_manifest_rule_errors", "P26_search_suite_errors", "S05_explode_packets", "W01_strictly_increasing", "W06_merge_intervals",
    "W06b_concurrency_sweep", "W13_moving_rate", "W16_rank_candidates", "W17_resample_drop",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    times: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINE:
        for target in (first, times):
            began = time.perf_counter()
            registry[name].build(spark, folder).write.format("noop").mode("overwrite").save()
            target[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "first_run": first}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
