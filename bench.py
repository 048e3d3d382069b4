"""Times the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS].

One warm-up and then the median of three runs per query; results are forced with a noop write.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casework.session import build_session  # noqa: E402

HEADLINE = {
    "detect_plans": "det_5_plans",
    "merge_continuations": "win_1_continuation_merge",
    "pending_time": "win_2_pending_time",
    "parse_mplog": "mpl_8_records",
    "chromium_visits": "join_1_chromium_visits",
    "coalesce_ranges": "win_3_range_coalesce",
    "usn_round_trip": "usn_1_record_split",
    "verify_hashes": "inv_11_hash_verification",
    "bulk_batches": "snk_4_bulk_batches",
    "fold_plan_state": "stm_2_plan_state",
    "progress": "win_9_progress",
    "info2": "inf_1_info2",
    "expected_vs_found": "inv_13_expected_vs_found",
    "path_dedup": "dst_2_path_dedup",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    import bindings.all  # noqa: F401
    from bindings.registry import QUERIES

    seconds: dict[str, float] = {}
    for name, key in HEADLINE.items():
        runs = []
        for attempt in range(4):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total of headline query medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
