"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "overall_score", "test_scores", "category_scores", "dag_criterion_score", "weakest_criteria", "recommendations",
    "weak_areas", "perf_summary", "nearest_rank_percentile", "cost_totals", "safety_summary", "safety_overall",
    "average_repeats", "ab_categories", "ab_tests", "ab_criteria", "pair_ab_history", "calibration_run",
    "red_team_overview", "merge_suite", "suite_violations", "parse_json_array", "judge_context", "build_judge_prompt",
    "version_line_diff", "carried_forward", "generate_responses", "judge_criteria", "history", "append_eval_run",
    "run_progress", "improvement_input", "improve_prompts",
]


def main() -> None:
    from gradeloom.plans.catalog import ALL
    from gradeloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        fn = ALL[name][0]
        best = None
        for _ in range(2):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, best of two runs each, summed", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
