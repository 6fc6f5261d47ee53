"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each query
is built and run to a no-op sink after one warm-up run of a small query; the
value is the sum over all queries of the median of BENCH_RUNS runs (3).
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from sitelode.plans.registry import all_queries
from sitelode.session import local_session

HEADLINE = (
    "pending_sites", "search_sites", "search_batch", "pending_jobs", "pending_jobs_per_site",
    "site_by_address", "site_upsert", "job_status_update", "cascade_delete", "site_children",
    "orphan_check", "domain_check", "unique_check", "mirror_groups", "status_rollup",
    "request_metrics", "audit_rollup", "change_detect", "latest_classification", "resource_state",
    "politeness_schedule", "queue_pop", "page_extract", "link_extract", "link_bfs", "page_cap",
    "discovery_run", "lang_detect", "pattern_flag", "safety_check", "risk_score", "rule_classify",
    "classify_run", "exact_dups", "text_simhash", "near_dups", "hash_upsert",
    "stream_request_metrics", "stream_job_state",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    queries["pending_sites"](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in chosen:
        taken = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
