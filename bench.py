"""Headline query timings at one scale; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
Results are fully computed and dropped (noop sink), nothing is collected.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nightdesk.plans.catalog import QUERIES  # noqa: E402
from nightdesk.session import build_session  # noqa: E402

HEADLINE = [
    "q01_lockouts", "q02_lockout_frequency", "q03_brute_force", "q04_password_spray", "q05_gpo_changes",
    "q07_unexpected_actors", "q10_high_privilege_group_adds", "q11_security_timeline", "q13_failed_logons_by_ip",
    "q17_kpi_board", "q25_unlocks_timeline", "x01_access_fields", "w05_requests_by_class", "w06_top_uris",
    "al02_alert_brute_force", "al05_alert_after_hours_admin", "st06_suppression",
    "tk03_build_tickets", "tk05_build_entries", "tk06_ticket_report", "dr02_user_summary", "dr04_list_groups",
    "dr07_plan_group_changes", "dr10_lockout_sources", "dr13_action_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Call-site capture costs a round trip per column expression.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        samples = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(samples[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
