"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (median counts).
Results go to the noop sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalog  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_worst_sources", "fp1_all_line_rules", "se1_hardcoded_secret", "src4_file_stats", "ix1_diff_snapshot",
    "ix6_resolve_imports", "ix8_decorator_endpoints", "ix15_section_chunks", "u1_upsert", "sc1_category_scores",
    "en2_evidence", "fp5_top_findings_health_report", "tm2_complexity", "tm9_duplicate_locations", "tm13_calls",
    "tm29_pattern_candidates", "gr2_strong_groups", "gr3_coupling", "gr4_dependency_depth", "gr10_unsafe_dependencies",
    "gr13_pr_impact_totals", "dl10_ci_rollup", "in3_detect_incidents", "in5_correlate_deployment", "in10_evidence_run",
    "wh1_route_webhooks", "rt1_vector_search", "rt5_pack_context", "ro1_commit_activity", "rep1_json_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "tidemark-bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
