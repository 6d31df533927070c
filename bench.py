"""Time the headline queries. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "ranked_queue", "queue_filtered", "queue_sorted_salary", "queue_facets", "posting_detail",
    "judge_candidates", "intake_breakdown", "place_audit_sets", "company_cost", "weekly_conversion",
    "latest_per_company", "score_histogram", "failure_streaks", "fingerprint_collapse",
    "normalized_postings", "pay_parse_by_source", "html_text", "place_class", "rule_cascade",
    "term_screen", "passage_screen", "cosine_topk", "cosine_all", "score_postings", "upsert_converges",
    "company_merge", "score_merge", "status_fold", "verdict_precedence", "rejudge_diff",
    "spend_by_day", "usage_rollup", "spend_under_cap", "question_match_prose", "answer_precedence",
    "platform_of_url", "thread_header_parse", "stream_first_last",
    "stream_daily_spend",
]


def main() -> None:
    from postmill.session import build_session
    from queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR", os.path.join(tempfile.gettempdir(), "bench-staged")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for attempt in range(repeats + 1):  # the first run warms up and is not counted
            started = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
            if attempt and sum(runs) > 20:
                break
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
