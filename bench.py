"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Each query runs once to warm up and then BENCH_RUNS
times (default 1); the median is reported. Results go to the no-op sink, so
every output column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from spendlake.plans import REGISTRY
from spendlake.session import local_session

HEADLINE = [
    "A1_spending_summary", "A2_summary_with_change", "A3_category_breakdown", "A4_focus_categories", "A5_trend_monthly", "A7_trend_summary",
    "A8_monthly_comparison", "A10_top_merchants", "A11_budget_status", "A13_category_change", "A14_category_analysis", "A20_recurring_patterns",
    "A23_benchmark_comparison", "A24_current_insights", "A30_forecast", "A31_anomalies", "C1_clean_amount", "C10_normalize",
    "C25_suspicious_text", "D2_peer_benchmark", "D4_recurring_transactions", "J9_contained_keywords", "J11_fuzzy_keywords",
    "J15_near_duplicates", "J16_tfidf_scores", "K1_deep_rank", "K1_page", "M7_categorize", "S7_rows_to_transactions", "S14_hdfc_layout", "S20_routed_statements",
    "ST3_rate_limit_audit", "ST4_lockout", "W1_half_split_trend", "W4_first_by_content_key", "W5_greedy_removal",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    REGISTRY[name].frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}
    for name in names:
        run(spark, name, sf_dir)
        print(f"{name} warm", file=sys.stderr, flush=True)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
