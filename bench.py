"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query
is computed in full into a sink that discards the rows; the figure is the better of
two runs, so that it shows the query rather than the start of the JVM.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clientele.queries import QUERIES  # noqa: E402
from clientele.session import local_session  # noqa: E402

HEADLINE = (
    "table_volumes", "customer_features", "rule_candidates", "rule_summary", "passthrough_plans",
    "resolved_plans", "plans_after_cooldown", "queued_actions", "decision_cycle_summary",
    "rendered_messages", "execution_batch", "execution_report", "updated_health", "marked_actions",
    "outcomes_applied", "customers_upserted", "constraint_report", "kpi_summary", "segment_metrics",
    "churn_ranking", "customer_list", "pending_queue", "data_summary", "classification_averages",
    "python_rule_candidates", "execution_run", "feedback_run_health", "streamed_health", "streamed_event_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
